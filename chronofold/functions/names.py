"""Runs of names cut into single names: a search with backtracking, so an Arrow function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the most frequent single surnames, and the double ones; a longer list can be given as a parameter
SURNAMES = ("王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林郑罗梁谢宋唐许韩冯邓曹彭曾田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦方邹孟熊秦邱江尹薛段雷侯龙史陶黎贺顾毛郝龚邵万钱严武戴莫孔向汤"
            "常温康施文牛樊葛邢安齐易乔伍庞颜倪庄聂章鲁翟殷詹申耿关焦俞左柳甘祝包宁尚符舒阮柯纪梅童凌毕单季裴霍成苗谷盛曲翁冉骆蓝路管柴鲍华喻祁房滕屈饶解艾尤穆吉简车项连褚娄窦戚岑景党宫费卜冷")
DOUBLE_SURNAMES = ("欧阳", "司马", "上官", "诸葛", "夏侯", "东方", "皇甫", "尉迟", "公孙", "慕容", "宇文", "司徒", "令狐")


def split_names(text: str | None, surnames: str = SURNAMES, doubles: tuple[str, ...] = DOUBLE_SURNAMES) -> str | None:
    """Names joined by 、. Stars, commas and spaces are removed; a text of up to four letters stays whole.

    Longer ones are cut into surnames with given names of two letters or one, from the left the longer first that lets the rest be cut;
    where that cannot be done the text stays whole. An outside teacher (外聘 and a number) is that alone, with the language in brackets.
    """
    if text is None:
        return None
    t = re.sub(r"[＊*、，,\s]", "", text)
    outside = re.search("外聘[0-9]+", t)
    if outside:
        language = re.search("[（(]([^）)]+)[）)]", t)
        return outside.group() + (f"（{language.group(1)}）" if language else "")
    n = len(t)
    if n <= 4:
        return t
    rest: list[list[str] | None] = [None] * n + [[]]  # how what begins at a place is cut
    for i in range(n - 1, -1, -1):
        head = 2 if t[i:i + 2] in doubles else 1 if t[i] in surnames else 0
        for end in ((i + head + 2, i + head + 1) if head else ()):
            if end <= n and rest[end] is not None:
                rest[i] = [t[i:end], *rest[end]]
                break
    return "、".join(rest[0]) if rest[0] else t


def split_names_column(c: Column, surnames: str = SURNAMES) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: split_names(x, surnames))

    return run(c)
