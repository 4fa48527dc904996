"""Chinese personal names by surname, shape and context, without a model. Partial by nature: high precision, modest recall."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The hundred commonest surnames by the census ranking that the Ministry of Public Security publishes.
SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
#: Compound surnames, by the number of their bearers in the same statistics.
DOUBLE = ("欧阳", "上官", "皇甫", "令狐", "诸葛", "司徒", "司马", "申屠", "夏侯", "贺兰", "完颜", "慕容", "尉迟", "长孙")
#: Context that by itself makes a name likely: what forms ask for before it, and forms of address after it.
STRONG_LEFT = ("姓名", "联系人", "收件人", "申请人", "患者", "客户", "我叫")
STRONG_RIGHT = ("先生", "女士", "小姐", "太太", "夫人", "老师", "教授", "博士", "律师", "医生", "护士", "师傅")
#: Weak context: two of these in a text are needed for a name without strong context.
WEAK = ("电话", "手机", "地址", "住址", "身份证", "签名", "出生")
#: Particles, pronouns and other words of grammar, which are no part of given names.
GRAMMAR = "的了是在不有这那和与就也都很吗呢吧我你他她它们个么什哪为被把从对到上下"

SHORT = rf"(?:{'|'.join(DOUBLE)}|[{SURNAMES}])[\x{{4e00}}-\x{{9fff}}]{{1,2}}?"
PATTERN = rf"(?:{'|'.join(DOUBLE)}|[{SURNAMES}])[\x{{4e00}}-\x{{9fff}}]{{1,2}}"


def name_ok(name: Column) -> Column:
    """Shape of a name without grammar in the given name; a title is no given name."""
    given = F.regexp_replace(name, rf"^(?:{'|'.join(DOUBLE)}|[{SURNAMES}])", "")
    return F.coalesce(name.rlike(rf"^(?:{PATTERN})$") & ~given.rlike(rf"[{GRAMMAR}]") & ~given.isin(*STRONG_RIGHT), F.lit(False))


def names(text: Column) -> Column:
    """array<string> of names: those with strong evidence next to them, and with two words of weak evidence in the text any that a separator precedes and follows."""
    left = F.regexp_extract_all(text, F.lit(rf"(?:{'|'.join(STRONG_LEFT)})(?:是|为|：|:|\s){{0,2}}({PATTERN})"), F.lit(1))
    right = F.regexp_extract_all(text, F.lit(rf"({SHORT})(?:{'|'.join(STRONG_RIGHT)})"), F.lit(1))
    alone = F.regexp_extract_all(text, F.lit(rf"(?:^|[\s，,、：:])({PATTERN})(?=$|[\s，,、。])"), F.lit(1))
    more = F.when(weak_context(text) >= 2, alone).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(F.concat(left, right, more))
    return F.coalesce(F.filter(found, name_ok), F.array().cast("array<string>"))


def weak_context(text: Column) -> Column:
    """Number of weak context words in a text."""
    return sum((text.contains(w).cast("int") for w in WEAK), F.lit(0))


def rejected(name: Column) -> Column:
    """Pseudo-names: what is no name by its shape."""
    return ~name_ok(name)
