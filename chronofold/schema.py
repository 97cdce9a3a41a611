"""Schemas and fixed values of the schedule domain."""

from __future__ import annotations

COURSE = "course_name string, teacher string, classroom string, day_of_week int, period_start int, period_end int, week_start int, week_end int, week_type string, specific_weeks array<int>"
EVENT = f"id string, title string, type string, start_time string, end_time string, location string, seat_number string, description string, reminder_minutes int, rrule string, week_type string, source string, confidence double, user_edited boolean, course struct<{COURSE.replace(' ', ':').replace(',:', ',')}>, raw_text string, warnings array<string>"
PERIOD = "period_number int, start_time string, end_time string, label string"
POSITIONED = "doc_id long, page int, seq int, text string, x double, y double"
OCR_CELL = "image_id long, seq int, kind string, row_index int, column_index int, day_of_week int, period_start int, period_end int, text string"

# fixed values: term start, bell schedule and days without classes
SEMESTER_START = "2026-09-07"
PERIODS = [
    (1, "08:00", "08:45", "第一节"), (2, "08:55", "09:40", "第二节"), (3, "10:10", "10:55", "第三节"), (4, "11:05", "11:50", "第四节"),
    (5, "14:00", "14:45", "第五节"), (6, "14:55", "15:40", "第六节"), (7, "16:10", "16:55", "第七节"), (8, "17:05", "17:50", "第八节"),
    (9, "19:00", "19:45", "第九节"), (10, "19:55", "20:40", "第十节"), (11, "20:50", "21:35", "第十一节"), (12, "21:45", "22:30", "第十二节"),
]
NO_CLASS_DATES = [
    "2026-01-01", "2026-01-02", "2026-01-03", "2026-02-15", "2026-02-16", "2026-02-17", "2026-02-18", "2026-02-19", "2026-02-20", "2026-02-21", "2026-02-22", "2026-02-23",
    "2026-04-04", "2026-04-05", "2026-04-06", "2026-05-01", "2026-05-02", "2026-05-03", "2026-05-04", "2026-05-05", "2026-06-19", "2026-06-20", "2026-06-21",
    "2026-09-25", "2026-09-26", "2026-09-27", "2026-10-01", "2026-10-02", "2026-10-03", "2026-10-04", "2026-10-05", "2026-10-06", "2026-10-07",
]

# fixed values: enumerations
EVENT_TYPES = ["COURSE", "EXAM", "HOMEWORK", "MEETING", "ACTIVITY", "REMINDER"]
WEEK_TYPES = ["EVERY_WEEK", "ODD_WEEK", "EVEN_WEEK", "SPECIFIC_WEEKS"]
WEEKDAYS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "日": 7, "天": 7}
NUMERALS = ["零", "一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二", "十三", "十四", "十五", "十六", "十七", "十八", "十九", "二十", "二十一", "二十二", "二十三", "二十四"]


def numeral_map(last: int = 24) -> dict[str, int]:
    """Chinese numerals as numbers, with the second form of two."""
    return {name: i for i, name in enumerate(NUMERALS) if i <= last} | {"两": 2}
