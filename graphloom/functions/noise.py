"""Noise filters for labels: one expression builder, four parameter sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.text import CJK, clean_label, letter_ratio, strip

# What marks a label as front matter, and the terms that are never noise.
COMMON = [
    r"^第\s*\d*\s*版(\s*\d+)?$", r"^版权所有", r"^侵权必究", r"^编委", r"^主编", r"^副主编", r"^数字编委", r"^主审", r"^编写秘书",
    r"^序言$", r"^前言$", r"^目录$", r"^新形态教材", r"^读者信息反馈", r"^修订说明", r"^规划教材修订", r"^全国高等学校", r"^简介",
    r"^图书在版编目", r"^CIP数据", r"^ISBN", r"^标准书号", r"^定价", r"^印张", r"^字数", r"^开本", r"^\d+$", r"^[\.\s·…]+$",
    r"^推荐阅读", r"^参考文献", r"^Page\s+\d+$", r"^\d+_\w+$", r"^第\s*[一二三四五六七八九十]+\s*章\s*$", r"^第\s*[一二三四五六七八九十]+\s*节\s*$",
]
BOOK = [
    r"^主\s*编", r"^副主编", r"^编\s*委", r"^供基础.*专业用$", r"^第\s*\d+\s*版", r"^\d+\.\d+", r"^[A-Za-z\s]+$", r"^\d{2,3}$",
    r"^.*出版社.*$", r"^\s*$", r"^.*医科大学.*$", r"^.*医学院.*$", r"^.*大学.*学院.*$", r"^.*附属.*医院.*$", r"^.*@.*$",
]
BULB = [r"^💡"]
LEADERS = [r"^.*\.{3,}.*$"]
SHOWN = [
    r"^国家卫生健康委员会", r"^全 国 高 等 学 校 教 材$", r"^供基础", r"^编\s*委", r"^主\s*编", r"^副主编", r"^第十轮", r"^修订说明", r"^中英文名词对照索引$",
    r"^前言$", r"^目录$", r"^附录$", r"^绪论\d*$", r"^第[一二三四五六七八九十]+章\s*$", r"^第[一二三四五六七八九十]+节\s*$", r"^[\d\s._-]+$", r"^💡",
]
SHORT_TERMS = (
    "心脏", "肺", "肝", "肾", "胃", "肠", "脑", "皮肤", "血液", "神经", "动脉", "静脉", "淋巴", "骨骼", "肌肉", "关节", "细胞", "组织",
    "免疫", "炎症", "肿瘤", "感染", "代谢", "激素", "基因", "蛋白", "心电图",
)
#: The terms that the filters without hints spare.
ORGANS = tuple(t for t in SHORT_TERMS if t != "心电图")
HINTS = ("调节", "组织", "细胞", "上皮", "神经", "血管", "心电", "心律", "代谢", "反射", "分泌", "激素", "免疫", "炎症", "病理", "生理", "胚胎", "器官")
GENERIC = (
    "从而", "一种", "系统的", "主要", "因此", "以及", "及其", "此外", "例如", "包括", "由于", "通过", "进行", "可以", "为了", "具有", "有关", "相关", "临床", "疾病",
    "异常", "治疗", "诊断", "预防", "评估", "应用", "作用", "功能", "特点", "结构", "概述", "概要", "开篇", "前言", "序言", "目录", "复习题", "思考题",
)
PUBLISHER = "出版社|规划教材|编委|主编|副主编|ISBN|CIP|版权所有|医学院|大学|医院"


@dataclass(frozen=True)
class Noise:
    """Lengths kept, patterns, least letter ratio; short: rules for short labels; names: short CJK labels are names of people."""

    least: int
    most: int
    patterns: tuple[str, ...]
    ratio: float
    short: bool = False
    names: bool = False
    always: tuple[str, ...] = ()
    hints: tuple[str, ...] = ()

    def __call__(self, label: Column) -> Column:
        t = strip(label)
        ratio, n = letter_ratio(t), F.length(t)
        noise = (n < self.least) | (n > self.most) | t.rlike("(?U)" + "|".join(f"({p})" for p in self.patterns)) | (ratio < self.ratio)
        if self.short:
            noise = noise | ((n < 5) & (ratio * n < 3)) | ((ratio < 0.5) & (n < 10))
        if self.names:
            plain = F.translate(t, " 　", "")
            spared = plain.isin(*ORGANS)
            if self.hints:
                spared = plain.isin(*SHORT_TERMS) | plain.rlike("|".join(self.hints))
            noise = noise | (plain.rlike(f"^[{CJK}]{{2,4}}$") & ~spared)
        return ~t.isin(*self.always) & noise if self.always else noise


BUILDER = Noise(3, 80, tuple(COMMON + BOOK), 0.3, short=True, names=True, always=SHORT_TERMS, hints=HINTS)
MERGER = Noise(2, 80, tuple(COMMON + LEADERS), 0.3)
ESSENCE = Noise(3, 80, tuple(COMMON + BOOK + BULB), 0.3, short=True, names=True)
EXPORT = Noise(2, 42, tuple(SHOWN), 0.45)


def noise_chunk(heading: Column, content: Column) -> Column:
    """A chunk whose heading is noise, or whose first 200 characters are hardly letters."""
    preview = strip(F.substring(content, 1, 200))
    return BUILDER(heading) | ((F.length(preview) > 20) & (letter_ratio(preview) < 0.2))


def valid_concept(text: Column, allow_short: bool = True) -> Column:
    t = clean_label(text)
    short = (F.length(t) < 4) & ~t.isin(*SHORT_TERMS) if allow_short else F.length(t) < 4
    return ~((t == "") | t.isin(*GENERIC) | short | (F.length(t) > 48) | BUILDER(t) | t.rlike(PUBLISHER))
