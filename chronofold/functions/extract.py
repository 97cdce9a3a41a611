"""Field extractors and routing as column functions over (mostly normalised) text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofold import schema
from chronofold.functions.text import DASH, LEFT, RIGHT, WS, filled, found, let, number, remove_first, route_text, trim
from chronofold.operators.calendar import next_weekday

DAY = "[一二三四五六日天]"
HOUR = "[一二两三四五六七八九十]{1,3}|[0-9]{1,2}"
HAN = "\u4e00-\u9fa5"

# fixed values: routing keywords in the order in which ties are decided, and the keywords of event types
ROUTES = {
    "COURSE": ["课程", "课表", "星期", "周一", "周二", "周三", "周四", "周五", "节", "教室", "教师", "任课"],
    "SCHEDULE": ["作息", "时间表", "第一节", "第二节", "上课时间", "下课时间", "教学计划"],
    "EXAM": ["考试", "考场", "笔试", "座位", "监考", "期末", "期中", "补考"],
    "HOMEWORK": ["作业", "提交", "截止", "DDL", "ddl", "课程设计", "实验报告", "论文"],
    "NOTICE": ["会议", "班会", "讲座", "活动", "报名", "通知", "微信", "微信群", "QQ", "QQ群", "截图"],
}
TYPES = {"EXAM": "考试|笔试|考场", "HOMEWORK": "作业|提交|截止|DDL|ddl", "MEETING": "班会|会议|例会", "ACTIVITY": "讲座|活动|报名"}
BUILDINGS = "教学楼|实验楼|实验室|综合楼|图书馆|体育馆|体育场|排球场|操场|运动场|晨曦排球场|工程训练中心|机房|教室|主楼|一教|二教|三教|四教|五教|逸夫楼|明德楼|笃行楼|博学楼|颐德楼|经世楼"
EXAM_NOISE = "打印时间|注意事项|准考证|学号|姓名|学院|班级|性别|有效身份证|身份证件|考生|考场规则|携带任何|不得参加考试"
COURSE_NOISE = rf"(?:课程表|课表|课程|任课教师|任课老师|教师|老师|地点|教室|上课地点|节次|周次){WS}*[:：]?"
CAMPUSES = "江安|望江|华西"


def weekday(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in schema.WEEKDAYS.items() for x in pair])
    return F.try_element_at(table, found(c, rf"(?:周|星期)({DAY})"))


def route_scores(c: Column) -> dict[str, Column]:
    return {k: reduce(lambda a, b: a + b, [F.when(c.contains(w), 1).otherwise(0) for w in words]) for k, words in ROUTES.items()}


def looks_like_exam_table(c: Column) -> Column:
    date, clock = r"20[0-9]{2}[^0-9]{1,6}[0-9]{1,2}[^0-9]{1,6}[0-9]{1,2}", r"[0-9]{1,2}:[0-9]{2}"
    first = rf"(?:\A|\n){WS}*[0-9]{{1,3}}{WS}+{date}[^0-9]{{0,16}}[（(]?{clock}{WS}*{DASH}{WS}*{clock}"
    tests = [date, rf"{clock}{WS}*{DASH}{WS}*{clock}", rf"(?:楼|教室|考场){WS}*[A-Za-z]?{WS}*[0-9]{{0,4}}|{LEFT}[A-Za-z]{WS}*[0-9]{{2,4}}{RIGHT}", rf"分散|集中|闭卷|开卷|{WS}[0-9]{{1,3}}{WS}*\z"]
    rows = lambda n: F.filter(F.split(n, r"[\r\n]+"), lambda x: reduce(lambda a, b: a & b, [x.rlike(t) for t in tests]))
    # a date's four digits stand in the text as it is: the repairs of ``route_text`` join no more than two
    return F.when(~c.contains("20"), False).otherwise(let(route_text(c), lambda n: n.rlike(first) | (F.size(rows(n)) >= 2)))


def route(c: Column) -> Column:
    """The intent of a text: exam tables first, then the most keywords; ties in the order of ROUTES."""
    def chosen(scores: Column) -> Column:
        best = F.greatest(*[scores[k] for k in ROUTES])
        out = F.when(best == 0, "NATURAL_LANGUAGE")
        for k in ROUTES:
            out = out.when(scores[k] == best, k)
        return out

    return F.when(looks_like_exam_table(c), "EXAM").otherwise(let(F.struct(*[s.alias(k) for k, s in route_scores(c).items()]), chosen))


def event_type(c: Column) -> Column:
    out = F.when(c.rlike(TYPES["EXAM"]), "EXAM")
    for k in ("HOMEWORK", "MEETING", "ACTIVITY"):
        out = out.when(c.rlike(TYPES[k]), k)
    return out.otherwise("REMINDER")


def is_exam_noise(c: Column) -> Column:
    return c.rlike(EXAM_NOISE) | c.rlike(rf"\A{WS}*(?:序号|序列|编号){WS}+.*考试")


def prefers_rules(c: Column) -> Column:
    """Three or more structured course rows, of which four in five name weeks and a teacher or place."""
    rows = F.filter(F.transform(F.split(c, r"[\r\n]+"), trim), lambda x: x.rlike(rf"\A(?:周|星期){DAY}{WS}+[0-9]{{1,2}}{WS}*{DASH}{WS}*[0-9]{{1,2}}{WS}*节"))
    full = F.filter(rows, lambda x: x.rlike(rf"[0-9]{{1,2}}{WS}*(?:{DASH}{WS}*[0-9]{{1,2}})?{WS}*周") & x.rlike(rf"(?:教师|地点){WS}*[:：]"))
    return (F.size(rows) >= 3) & (F.size(full) * 5 >= F.size(rows) * 4)


def is_sparse(c: Column, site: str = "") -> Column:
    """Fewer than 30 meaningful characters and fewer than two signs of a timetable. site: a host whose addresses do not count."""
    m = F.regexp_replace(c, r"(?i)https?://\S+", " ")
    if site:
        m = F.regexp_replace(m, rf"(?i){LEFT}\S+\.{site}\S*", " ")
    for p in (rf"{LEFT}20[0-9]{{2}}[/-][0-9]{{1,2}}[/-][0-9]{{1,2}}{RIGHT}", rf"{LEFT}[0-9]{{1,2}}:[0-9]{{2}}{RIGHT}", rf"选课结果|课程表|第{WS}*[0-9]+{WS}*页|[0-9]+{WS}*/{WS}*[0-9]+"):
        m = F.regexp_replace(m, p, " ")
    signs = F.regexp_count(c, F.lit(rf"星期{DAY}|周{DAY}|[0-9]{{1,2}}{WS}*{DASH}{WS}*[0-9]{{1,2}}{WS}*节|教师|场地"))
    return (F.length(F.regexp_replace(m, f"[^{HAN}A-Za-z0-9]", "")) < 30) & (signs < 2)


def _two(c: Column) -> Column:
    return F.lpad(c, 2, "0")


def date_of(c: Column, as_of: Column) -> Column:
    """YYYY-MM-DD from a full date, month and day, or words relative to ``as_of``; null without any. c is normalised."""
    full = r"(20[0-9]{2})[^0-9]{1,6}([0-9]{1,2})[^0-9]{1,6}([0-9]{1,2})"
    parts = F.transform(F.regexp_extract_all(c, F.lit(full), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, full, 1).alias("y"), F.regexp_extract(x, full, 2).alias("m"), F.regexp_extract(x, full, 3).alias("d")))
    valid = F.filter(parts, lambda p: p["m"].try_cast("int").between(1, 12) & p["d"].try_cast("int").between(1, 31))
    exact = let(F.try_element_at(valid, F.lit(1)), lambda p: F.when(p.isNotNull(), F.concat_ws("-", p["y"], _two(p["m"]), _two(p["d"]))))
    month_day = rf"(?:\A|[^0-9])([0-9]{{1,2}}){WS}*[月/.]{WS}*([0-9]{{1,2}}){WS}*[日号]?"
    table = F.create_map(*[F.lit(x) for pair in schema.WEEKDAYS.items() for x in pair])
    day = lambda p: F.try_element_at(table, found(c, p))
    short = let(found(c, month_day, 0), lambda m: F.when(m.isNotNull(), F.concat_ws("-", F.year(as_of).cast("string"), _two(F.regexp_extract(m, month_day, 1)), _two(F.regexp_extract(m, month_day, 2)))))
    return F.coalesce(exact, short, F.when(c.rlike("今天|今晚"), as_of.cast("string")).when(c.contains("明天"), F.date_add(as_of, 1).cast("string")).when(c.contains("后天"), F.date_add(as_of, 2).cast("string"))
            .when(c.rlike(f"下周{DAY}"), next_weekday(as_of, day(f"下周({DAY})"), F.lit(True)).cast("string"))
            .when(c.rlike(f"周{DAY}"), next_weekday(as_of, day(f"(?:本周|这周|周)({DAY})"), F.lit(False)).cast("string")))


def in_day(hour: Column, c: Column) -> Column:
    """An hour moved to the afternoon where the text says so."""
    return let(hour, lambda h: F.when((h < 12) & c.rlike("下午|晚上|今晚"), h + 12).when((h < 11) & c.contains("中午"), h + 12).otherwise(h))


def time_range(c: Column) -> Column:
    """struct(start, end) of HH:MM, null without a range. An exam's start before 10 is moved by ten hours where the span shows a lost digit."""
    p = rf"([0-9]{{1,2}}:[0-9]{{2}}){WS}*{DASH}{WS}*([0-9]{{1,2}}:[0-9]{{2}})"
    hp = rf"({HOUR}){WS}*点{WS}*{DASH}{WS}*({HOUR}){WS}*点?"
    hour_of = lambda t: F.substring(t, 1, 2).try_cast("int")

    def clocks(m: Column) -> Column:
        s, e = (F.lpad(F.regexp_extract(m, p, g), 5, "0") for g in (1, 2))
        return let(F.struct(s.alias("s"), hour_of(s).alias("sh"), e.alias("e"), hour_of(e).alias("eh")), moved)

    def moved(t: Column) -> Column:
        lost = (t["sh"] < 10) & (t["eh"] - t["sh"] > 4) & (t["sh"] + 10 < t["eh"]) & c.rlike("考试|准考证|分散|集中|闭卷|开卷")
        return F.struct(F.when(lost, F.concat(_two((t["sh"] + 10).cast("string")), F.substring(t["s"], 3, 10))).otherwise(t["s"]).alias("start"), t["e"].alias("end"))

    def spoken(m: Column) -> Column:
        return let(F.struct(number(F.regexp_extract(m, hp, 1)).alias("a"), number(F.regexp_extract(m, hp, 2)).alias("b")), lambda h: F.when((h["a"] > 0) & (h["b"] > 0), let(F.struct(in_day(h["a"], c).alias("a"), in_day(h["b"], c).alias("b"), h["b"].alias("said")), hours)))

    def hours(h: Column) -> Column:
        clock = lambda x: F.concat(_two(x.cast("string")), F.lit(":00"))
        return F.struct(clock(h["a"]).alias("start"), clock(F.when((h["b"] <= h["a"]) & (h["a"] >= 12) & (h["said"] < 12), h["said"] + 12).otherwise(h["b"])).alias("end"))

    # each pattern is searched once; what it found is taken apart
    return F.coalesce(let(found(c, p, 0), lambda m: F.when(m.isNotNull(), clocks(m))), let(found(c, hp, 0), lambda m: F.when(m.isNotNull(), spoken(m))))


def time_of(c: Column) -> Column:
    """struct(start, end): a range, else a clock time and an hour more, else a spoken hour (9 without any) and one hour more, two for exams. Hours past 23 stay."""
    at = lambda t: F.when(t.isNotNull(), F.struct(t.alias("start"), F.concat(_two((F.substring(t, 1, 2).try_cast("int") + 1).cast("string")), F.substring(t, 3, 10)).alias("end")))
    clock = let(F.lpad(found(c, "([0-9]{1,2}:[0-9]{2})"), 5, "0"), at)
    more = F.when(c.rlike("考试|笔试"), 2).otherwise(1)
    full = lambda h: F.concat(_two(h.cast("string")), F.lit(":00"))
    spoken = let(in_day(F.coalesce(number(found(c, rf"({HOUR}){WS}*点")), F.lit(9)), c), lambda h: F.struct(full(h).alias("start"), full(h + more).alias("end")))
    return F.coalesce(time_range(c), clock, spoken)


def location(c: Column) -> Column:
    """An online place, a labelled one, a known building with its room, or a room code; null without any."""
    return F.coalesce(found(c, "线上会议|腾讯会议|微信群|QQ群|线上", 0), trim(found(c, rf"(?:地点|教室|考场|上课地点){WS}*[:：]?{WS}*([^，。,.；;\n]+)")),
                      trim(found(c, rf"(?:{CAMPUSES})?(?:{BUILDINGS}){WS}*[{HAN}A-Za-z0-9-]*", 0)), found(c, rf"{LEFT}[A-Za-z]-?[0-9]{{3,4}}{RIGHT}", 0))


def seat(c: Column, place: Column) -> Column:
    labelled = found(c, rf"(?:座位号?|座号|座位){WS}*[:：]?{WS}*([0-9]{{1,4}})")
    at = F.instr(c, place)
    tail = F.when(place.isNotNull() & (at > 0), F.substring(c, at + F.length(place), F.length(c))).otherwise(c)
    return F.coalesce(labelled, found(tail, rf"\A{WS}*([0-9]{{1,4}}){WS}*(?:分散|集中|闭卷|开卷|\z)"))


def teacher(c: Column) -> Column:
    coded = found(c, rf"_[0-9]{{2}}{WS}+([{HAN}·,，、（）()0-9]{{1,24}})(?={WS}+(?:第?[0-9]{{1,2}}{WS}*[-~,，、至到]|{CAMPUSES}))")
    return F.coalesce(found(c, rf"(?:教师|任课教师|任课老师){WS}*[:：]{WS}*([{HAN}·,，、（）()0-9]{{1,40}})"), found(c, f"[{HAN}·,，、]{{1,16}}(?:老师|教授|讲师)", 0), trim(F.regexp_replace(coded, "[”\"'“]+\\z", "")))


def week_rule(c: Column) -> Column:
    """struct(week_start, week_end, week_type, specific_weeks)."""
    one, span = rf"第?{WS}*([0-9]{{1,2}}){WS}*周", rf"([0-9]{{1,2}}){WS}*{DASH}{WS}*([0-9]{{1,2}}){WS}*周"
    kind = F.when(c.contains("单周"), "ODD_WEEK").when(c.contains("双周"), "EVEN_WEEK").otherwise("EVERY_WEEK")

    def rule(x: Column) -> Column:
        weeks, bound = x["weeks"], lambda g, other: F.coalesce(found(x["span"], span, g).try_cast("int"), F.lit(other))
        return F.struct(F.when(x["listed"], F.array_min(weeks)).otherwise(bound(1, 1)).alias("week_start"), F.when(x["listed"], F.array_max(weeks)).otherwise(bound(2, 16)).alias("week_end"),
                        F.when(x["listed"], "SPECIFIC_WEEKS").otherwise(kind).alias("week_type"), F.when(x["listed"], weeks).alias("specific_weeks"))

    def read(x: Column) -> Column:
        listed = ((F.size(x["weeks"]) > 1) & x["span"].isNull()) | ((F.size(x["weeks"]) == 1) & c.rlike(rf"第{WS}*[0-9]{{1,2}}{WS}*周"))
        return let(F.struct(x["weeks"].alias("weeks"), x["span"].alias("span"), listed.alias("listed")), rule)

    return let(F.struct(F.transform(F.regexp_extract_all(c, F.lit(one), F.lit(1)), lambda x: x.try_cast("int")).alias("weeks"), found(c, span, 0).alias("span")), read)


def period_range(c: Column) -> Column:
    """struct(start, end), null without periods: a range with its unit, a bare range that is no week range, a single period."""
    sep = "[-~至到,，、]"
    unit, loose, single = rf"(?:第{WS}*)?([0-9]{{1,2}}){WS}*{sep}{WS}*([0-9]{{1,2}}){WS}*[节课]", rf"(?:\A|{WS})([0-9]{{1,2}}){WS}*{sep}{WS}*([0-9]{{1,2}})(?!{WS}*周)(?={WS}|[^0-9])", rf"(?:第{WS}*)?([0-9]{{1,2}}){WS}*[节课]"
    # each pattern is searched once; the numbers are taken from what it found
    first, last = "([0-9]{1,2})", "[0-9]{1,2}[^0-9]+([0-9]{1,2})"
    pair = lambda p, end: let(found(c, p, 0), lambda m: F.when(m.isNotNull(), F.struct(F.regexp_extract(m, first, 1).try_cast("int").alias("start"), F.regexp_extract(m, end, 1).try_cast("int").alias("end"))))
    return F.coalesce(pair(unit, last), pair(loose, last), pair(single, first))


def course_name(c: Column, who: Column, where: Column) -> Column:
    """What is left of a line without teacher, place, day, periods, weeks and labels; a coded name alone if there is one."""
    sep = "[-~至到,，、]"
    n = remove_first(remove_first(c, who), where)
    for p in (f"(?:周|星期){DAY}", rf"(?:第{WS}*)?[0-9]{{1,2}}{WS}*{sep}{WS}*[0-9]{{1,2}}{WS}*[节课]", rf"(?:\A|{WS})[0-9]{{1,2}}{WS}*{sep}{WS}*[0-9]{{1,2}}(?!{WS}*周)(?={WS}|[^0-9])",
              rf"第?{WS}*[0-9]{{1,2}}{WS}*{DASH}{WS}*[0-9]{{1,2}}{WS}*周", rf"第?{WS}*[0-9]{{1,2}}{WS}*周", "[单双]周", COURSE_NOISE):
        n = F.regexp_replace(n, p, " ")
    squeeze = lambda x: F.regexp_replace(x, rf"{WS}+", " ")
    coded = lambda x: squeeze(found(x, rf"\A(.+?_[0-9]{{2}})(?:{WS}|\z)"))
    plain = lambda x: F.regexp_replace(squeeze(F.regexp_replace(x, "[、，,。]", " ")), f"([{HAN}]):(?=[{HAN}])", "$1：")
    return trim(let(n, lambda x: F.coalesce(coded(x), plain(x))))


def course_confidence(who: Column, where: Column, line: Column, name: Column) -> Column:
    weeks = line.rlike(rf"第?{WS}*[0-9]{{1,2}}{WS}*(?:[-~,，、至到]{WS}*[0-9]{{1,2}})?{WS}*周|[单双]周")
    add = lambda test, v: F.when(test, v).otherwise(0.0)
    return F.least(F.lit(0.92), F.lit(0.55) + add(who.isNotNull(), 0.12) + add(where.isNotNull(), 0.12) + add(weeks, 0.08) + add(name.rlike(f"_[0-9]{{2}}{RIGHT}"), 0.05))


def without_when_and_where(c: Column, where: Column | None = None) -> Column:
    """Dates, times and the place (``where``, found here if not given) taken out. c is normalised."""
    h = "[一二两三四五六七八九十]{1,3}"
    n = c
    for p in (r"20[0-9]{2}[^0-9]{1,6}[0-9]{1,2}[^0-9]{1,6}[0-9]{1,2}[^0-9]?", rf"(?:\A|[^0-9])[0-9]{{1,2}}{WS}*[月/.]{WS}*[0-9]{{1,2}}{WS}*[日号]?", f"(?:今天|今晚|明天|后天|本周|这周|下周|周|星期){DAY}?",
              rf"[0-9]{{1,2}}:[0-9]{{2}}{WS}*{DASH}{WS}*[0-9]{{1,2}}:[0-9]{{2}}", "[0-9]{1,2}:[0-9]{2}", rf"{h}{WS}*点{WS}*{DASH}{WS}*{h}{WS}*点?", rf"[早上午中下晚今]*{WS}*{h}{WS}*点半?", rf"地点{WS}*[:：]?{WS}*[^，。,.；;]*"):
        n = F.regexp_replace(n, p, " ")
    rest = let(F.struct(n.alias("n"), (location(c) if where is None else where).alias("w")), lambda x: remove_first(x["n"], x["w"]))
    return trim(F.regexp_replace(rest, rf"{WS}+", " "))


def homework_title(c: Column, stripped: Column | None = None) -> Column:
    named = found(c, rf"提交{WS}*([^，。,.；;前]+?(?:实验报告|课程设计|作业|论文|报告|材料|表格))")
    rest = F.regexp_replace(F.regexp_replace(without_when_and_where(c) if stripped is None else stripped, "作业通知|通知|请在|请于|截止|提交|前|完成", " "), rf"{WS}+", "")
    return F.concat(F.lit("提交"), F.coalesce(F.regexp_replace(named, rf"{WS}+", ""), filled(rest), F.lit("作业")))


def natural_title(c: Column, stripped: Column | None = None) -> Column:
    bare = trim(F.regexp_replace(F.regexp_replace(without_when_and_where(c) if stripped is None else stripped, "考试安排|作业通知|通知|请在|请于|截止|提交|前", " "), rf"{WS}+", " "))
    head = F.substring(F.regexp_replace(c, r"[，。,.].*\z", ""), 1, 40)
    own = let(bare, lambda x: F.when(x.contains("班会"), "班会").otherwise(filled(x)))
    return F.when(event_type(c) == "HOMEWORK", homework_title(c, stripped)).otherwise(F.coalesce(own, filled(head), F.lit("校园提醒")))


def exam_title(c: Column, where: Column | None = None) -> Column:
    """The subject of an exam row; ends with 考试."""
    labelled = found(c, rf"(?:考试科目|课程名称|科目|课程){WS}*[:：]?{WS}*([^，。；;\n]+?)(?={WS}*(?:考试时间|考试日期|考试地点|考场|座位|备注|\z))")
    n = let(F.struct(F.coalesce(labelled, c).alias("n"), (location(c) if where is None else where).alias("w")), lambda x: remove_first(x["n"], x["w"]))
    clock = r"[0-9]{1,2}:[0-9]{2}"
    for p in (rf"\A{WS}*[0-9]{{1,3}}{WS}+", r"20[0-9]{2}[^0-9]{1,6}[0-9]{1,2}[^0-9]{1,6}[0-9]{1,2}[^0-9]?", rf"(?:\A|[^0-9])[0-9]{{1,2}}{WS}*月{WS}*[0-9]{{1,2}}{WS}*日?", rf"\A{WS}*月{WS}*[0-9]{{1,2}}{WS}*日?{WS}*",
              rf"\A(?:{WS}|[日号（）()])+", rf"\A{WS}*[0-9]{{1,3}}{WS}+", rf"[（(]{WS}*{clock}{WS}*{DASH}{WS}*{clock}{WS}*[)）]", rf"{clock}{WS}*{DASH}{WS}*{clock}", rf"\A(?:{WS}|[)）])+",
              "考试科目|课程名称|考试日期|考试时间|考试地点|考场|地点|座位号?|座号|备注", rf"{LEFT}[A-Za-z]-?[0-9]{{3,4}}{RIGHT}", rf"{LEFT}[0-9]{{1,3}}{WS}*(?:分散|集中|闭卷|开卷)?{WS}*\z", rf"(?:分散|集中|闭卷|开卷){WS}*\z"):
        n = F.regexp_replace(n, p, " ")
    n = F.regexp_replace(n, rf"(?i)\({WS}*c{WS}*语言{WS}*\)", "（C语言）")
    n = F.regexp_replace(F.regexp_replace(F.regexp_replace(n, "[:：]", " "), rf"{WS}+([（])", "$1"), rf"([）]){WS}+", "$1")
    n = trim(F.regexp_replace(n, rf"{WS}+", " "))
    return let(n, lambda x: F.when(x.contains("考试"), x).otherwise(F.concat(x, F.lit("考试"))))


def title_for(c: Column, kind: Column, where: Column | None = None, stripped: Column | None = None) -> Column:
    """The title by type. where and stripped: place and stripped text, if they are already columns."""
    return F.when(kind == "HOMEWORK", homework_title(c, stripped)).when(kind == "EXAM", exam_title(c, where)).otherwise(natural_title(c, stripped))


def ocr_score(c: Column) -> Column:
    """How much a recognised text looks like a timetable or an exam table."""
    from chronofold.functions.text import compact_exam_row

    t = compact_exam_row(c)
    count = lambda p: F.regexp_count(t, F.lit(p))
    weights = [(rf"(?:20[0-9]{{2}}{WS}*年?)?{WS}*[0-9]{{1,2}}{WS}*月{WS}*[0-9]{{1,2}}{WS}*日?", 8.0), (rf"[0-9]{{1,2}}{WS}*:{WS}*[0-9]{{2}}", 5.0),
               (rf"(?:经世楼|颐德楼|明德楼|笃行楼|教学楼|实验楼|晨曦排球场){WS}*[A-Za-z]?{WS}*[0-9]{{0,4}}", 7.0),
               ("数据结构|面向对象|中国传统文化|心理健康|离散数学|中国近现代史|高等数学|马克思主义|概率论|大学物理|计算机网络|数字经济|算法分析", 6.0), (rf"周{DAY}|[0-9]{{1,2}}{WS}*{DASH}{WS}*[0-9]{{1,2}}{WS}*节", 4.0), (r"[|丨]", 1.5)]
    total = reduce(lambda a, b: a + b, [count(p) * w for p, w in weights])
    useful = F.least(F.length(F.regexp_replace(t, r"注意事项[\s\S]*\z", "")), F.lit(900)) / 120.0
    return total + useful - F.when(t.rlike("注意事项|有效身份证|准考证正|打印时间"), 18.0).otherwise(0.0)


def reading_score(c: Column) -> Column:
    """The score by which readings of an image in the browser are compared: dates, times, places, titles, slots and length count, signs of a notice are taken off."""
    t = F.regexp_replace(c, rf"{WS}+", " ")
    # fixed values: what counts, and how much
    weights = [(rf"(?:20[0-9]{{2}}{WS}*年)?{WS}*[0-9]{{1,2}}{WS}*月{WS}*[0-9]{{1,2}}{WS}*日?", 8.0), (rf"[0-9]{{1,2}}{WS}*:{WS}*[0-9]{{2}}", 5.0), (rf"(?:经世楼|颐德楼|明德楼|笃行楼|教学楼|实验楼|晨曦排球场){WS}*[A-Za-z]?{WS}*[0-9]{{0,4}}", 7.0),
               ("数据结构|面向对象|中国传统文化|心理健康|离散数学|中国近现代史|高等数学|马克思主义|概率论|大学物理|计算机网络|数字经济|算法分析|创新程序", 6.0), (rf"周{DAY}|[0-9]{{1,2}}{WS}*[-~至到]{WS}*[0-9]{{1,2}}{WS}*节", 4.0)]
    total = reduce(lambda a, b: a + b, [F.regexp_count(t, F.lit(p)) * w for p, w in weights])
    return total + F.least(F.length(t), F.lit(1000)) / 120.0 - F.when(t.rlike("注意事项|有效身份证|打印时间"), 12.0).otherwise(0.0)
