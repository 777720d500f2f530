"""Deadlines stated in text (date, weekday, time, zone) and local times as instants.

A text is cut into numbers, words and signs, and dates, times and zones are read
from those tokens; the reader is one Arrow-batched pandas UDF over short texts.
Zones, daylight saving and status are settled by Spark expressions.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.batched import per_distinct

# Names and short names of months and weekdays.
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
SHORT = {"sept": "september", "tues": "tuesday", "weds": "wednesday", "thur": "thursday", "thurs": "thursday"} | {name[:3]: name for name in MONTHS + WEEKDAYS}
#: Phrases that name a zone, and the zone each means.
ZONES = {"uk time": "Europe/London", "london time": "Europe/London", "utc": "UTC", "gmt": "UTC"}
#: Where the zone of a deadline comes from.
STATED, DEFAULT, UNKNOWN = "explicit_source", "institution_default", "unknown"

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")


@dataclass(frozen=True, slots=True)
class Token:
    """A number, word or sign; ``glued`` says that no white space stands before it."""

    text: str
    start: int
    end: int
    glued: bool

    @property
    def low(self) -> str:
        return self.text.lower()

    @property
    def digits(self) -> int:
        """How many digits the token has, none if it is no number."""
        return len(self.text) if "0" <= self.text[0] <= "9" else 0


#: Stands for what is before and behind a text.
_NONE = Token(" ", -1, -1, False)


@dataclass(frozen=True, slots=True)
class Dated:
    """A full date at a place; no date where there is no such day. The weekday is from 0 on Monday."""

    start: int
    end: int
    date: datetime.date | None
    weekday: int | None


class Reader:
    """What the tokens of one text state."""

    def __init__(self, text: str):
        found = list(_TOKEN.finditer(text))
        ends = [-1, *(m.end() for m in found)]
        self.tokens = [Token(m[0], m.start(), m.end(), m.start() == before) for m, before in zip(found, ends)]

    def at(self, i: int) -> Token:
        return self.tokens[i] if 0 <= i < len(self.tokens) else _NONE

    def sign(self, i: int, signs: str) -> bool:
        """Whether a sign of ``signs`` stands at i, next to the token before it."""
        return self.at(i).glued and self.at(i).text in signs

    def edge(self, i: int) -> bool:
        """Whether a word or number could end before token i, or begin there."""
        pair = self.at(i - 1).text, self.at(i).text
        return not self.at(i).glued or not all(t[0].isalnum() or t == "_" for t in pair)

    def named(self, i: int, names: list[str]) -> int | None:
        """Which of the names token i is, in full or short."""
        word = SHORT.get(self.at(i).low, self.at(i).low)
        return names.index(word) if word in names else None

    def _year_behind(self, i: int) -> int | None:
        """The place of a four-digit year at i that white space or nothing parts from what is before."""
        return i if self.at(i).digits == 4 and not self.at(i).glued and self.edge(i + 1) else None

    def _day(self, i: int) -> tuple[int, int] | None:
        """A day of one or two digits, maybe with the ending of an ordinal, and the place behind it."""
        if not 1 <= self.at(i).digits <= 2:
            return None
        ordinal = self.at(i + 1).glued and self.at(i + 1).low in ("st", "nd", "rd", "th")
        return (int(self.at(i).text), i + 2) if ordinal else (int(self.at(i).text), i + 1) if self.edge(i + 1) else None

    def _day_then_month(self, i: int) -> tuple[int, int, int] | None:
        """Month, day and the year's place, of "3rd of March 2026"."""
        day = self._day(i)
        if day is None or not self.edge(i):
            return None
        j = day[1] + (self.at(day[1]).low == "of" and not self.at(day[1]).glued)
        month = self.named(j, MONTHS)
        if month is None or self.at(j).glued:
            return None
        j += 1
        while self.sign(j, ".,"):
            j += 1
        year = self._year_behind(j)
        return None if year is None else (month, day[0], year)

    def _month_then_day(self, i: int) -> tuple[int, int, int] | None:
        """Month, day and the year's place, of "March 3rd, 2026"."""
        month = self.named(i, MONTHS)
        if month is None or not self.edge(i):
            return None
        j = i + 1 + self.sign(i + 1, ".")
        day = None if self.at(j).glued else self._day(j)
        if day is None:
            return None
        year = self._year_behind(day[1] + self.sign(day[1], ","))
        return None if year is None else (month, day[0], year)

    def _weekday_before(self, i: int) -> int | None:
        """The place of a weekday's name that white space, and maybe a point or comma, parts from token i."""
        j = i - 1
        while self.sign(j, ".,"):
            j -= 1
        return j if self.named(j, WEEKDAYS) is not None and not self.at(i).glued else None

    def dates(self) -> Iterator[Dated]:
        for i, token in enumerate(self.tokens):
            parts = self._day_then_month(i) or self._month_then_day(i)
            if parts:
                month, day, year = parts
                w = self._weekday_before(i)
                yield Dated(token.start if w is None else self.at(w).start, self.at(year).end, _date(int(self.at(year).text), month + 1, day), None if w is None else self.named(w, WEEKDAYS))
            elif token.digits == 4 and self.edge(i) and all(self.sign(i + k, "-") and self.at(i + k + 1).glued and self.at(i + k + 1).digits == 2 for k in (1, 3)) and self.edge(i + 5):
                yield Dated(token.start, self.at(i + 4).end, _date(int(token.text), int(self.at(i + 2).text), int(self.at(i + 4).text)), None)

    def numeric(self) -> bool:
        """Whether numbers parted by slashes or dots stand where day and month cannot be told apart."""
        for i in range(len(self.tokens)):
            parts = [self.at(i + k) for k in (0, 2, 4)]
            joined = all(self.sign(i + k, "/.") and self.at(i + k + 1).glued for k in (1, 3))
            if joined and all(1 <= p.digits <= 2 for p in parts[:2]) and 2 <= parts[2].digits <= 4 and self.edge(i) and self.edge(i + 5):
                return True
        return False

    def month_and_year(self) -> bool:
        return any(self.named(i, MONTHS) is not None and self.edge(i) and self._year_behind(i + 1) for i in range(len(self.tokens)))

    def _half(self, i: int) -> tuple[str, int] | None:
        """a or p of "am", "p.m." and the like at i, and the place behind."""
        low = self.at(i).low
        if low in ("am", "pm"):
            return low[0], i + 1 + self.sign(i + 1, ".")
        if low in ("a", "p") and self.sign(i + 1, ".") and self.at(i + 2).glued and self.at(i + 2).low == "m":
            return low, i + 3 + self.sign(i + 3, ".")
        return None

    def times(self) -> Iterator[tuple[str | None, int]]:
        """Times of day as HH:mm, none for impossible ones, and the place behind each."""
        for i, token in enumerate(self.tokens):
            if token.low in ("noon", "midday") and self.edge(i) and self.edge(i + 1):
                yield "12:00", i + 1
            if not 1 <= token.digits <= 2 or token.glued and self.at(i - 1).text in ".:":
                continue
            hour, minute = int(token.text), self.at(i + 2)
            if self.sign(i + 1, ":"):
                if minute.glued and minute.digits == 2 and not self.sign(i + 3, ":"):
                    half = self._half(i + 3)
                    fits = int(minute.text) < 60 and (1 <= hour <= 12 if half else hour < 24)
                    yield _clock(hour, int(minute.text), half and half[0]) if fits else None, half[1] if half else i + 3
                continue
            dotted = self.sign(i + 1, ".") and minute.glued and minute.digits == 2 and int(minute.text) < 60
            half = self._half(i + 3 if dotted else i + 1)
            if half and 1 <= hour <= 12:
                yield _clock(hour, int(minute.text) if dotted else 0, half[0]), half[1]

    def midnight(self) -> bool:
        return any(t.low == "midnight" for t in self.tokens)

    def _zone_named(self, i: int) -> str | None:
        """What a time's end at i is followed by: one or two words and "time", or two to five capitals, maybe with an offset."""
        i += self.at(i).text == "("
        letters = [t.text.isascii() and t.text.isalpha() for t in (self.at(i), self.at(i + 1))]
        for n in (1, 2):
            if all(letters[:n]) and self.at(i + n).low == "time":
                return " ".join(self.at(i + k).low for k in range(n + 1))
        word = self.at(i).text
        if not (letters[0] and word.isupper() and 2 <= len(word) <= 5):
            return None
        if self.at(i + 1).text in "+-" and 1 <= self.at(i + 2).digits <= 4:
            return f"{word.lower()}{self.at(i + 1).text}{self.at(i + 2).text}"
        return word.lower()

    def zone(self) -> tuple[str | None, str | None]:
        """The one zone whose phrase occurs, or why there is none: a time names another, or several occur."""
        words = [t.low for t in self.tokens]
        said = {" ".join(words[i : i + n]) for n in (1, 2) for i in range(len(words))}
        zones = {zone for phrase, zone in ZONES.items() if phrase in said}
        named = {self._zone_named(i) for _, i in self.times()} - {None}
        if named - set(ZONES):
            return None, "unrecognised_timezone"
        return (None, "conflicting_timezone") if len(zones) > 1 else (min(zones, default=None), None)


def _date(year: int, month: int, day: int) -> datetime.date | None:
    try:
        return datetime.date(year, month, day)
    except ValueError:
        return None


def _clock(hour: int, minute: int, half: str | None) -> str:
    return f"{hour % 12 + 12 * (half == 'p') if half else hour:02}:{minute:02}"


def read_deadline(text: str) -> dict:
    """The one deadline of a text: date, time, zone; ``reason`` refuses it, ``review`` lists what a reader must look at."""
    reader = Reader(text)
    dates = list(reader.dates())
    days = {d.date for d in dates}
    times = {t for t, _ in reader.times()}
    midnight = reader.midnight()
    reasons = {
        "numeric_date": reader.numeric(),
        "impossible_date": None in days,
        "month_only": not days and reader.month_and_year(),
        "no_date": not days,
        "several_dates": len(days) > 1,
        "impossible_time": None in times,
        "several_times": len(times) + midnight > 1,
    }
    reason = next((name for name, holds in reasons.items() if holds), None)
    out = {"date": None, "time": None, "zone": None, "reason": reason, "review": []}
    if reason is None:
        day = next(iter(days))
        zone, unclear = reader.zone()
        wrong = {d.weekday for d in dates} - {None, day.weekday()}
        review = [("ambiguous_time", midnight), (unclear, unclear), ("weekday_mismatch", wrong)]
        out |= {"date": day, "time": next(iter(times), None), "zone": zone, "review": [name for name, holds in review if holds]}
    return out


_DEADLINE = T.StructType([T.StructField("date", T.DateType()), *(T.StructField(c, T.StringType()) for c in ("time", "zone", "reason")), T.StructField("review", T.ArrayType(T.StringType()))])
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("date", T.DateType())]))


def _deadline(text: str | None) -> dict:
    return read_deadline(text or "")


def _date_spans(text: str | None) -> list[dict]:
    return [{"start": d.start, "end": d.end, "date": d.date} for d in Reader(text or "").dates()]


#: struct(date, time, zone, reason, review), see ``read_deadline``; a null text states no date.
deadline = per_distinct(_deadline, _DEADLINE)
#: Where full dates stand, by code points, end exclusive; a weekday before one belongs to it. Null dates are impossible ones.
date_spans = per_distinct(_date_spans, _SPANS)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def local_instant(local: Column, zone: str | Column) -> Column:
    """struct(instant, state) of a wall-clock time: exact, in a gap (no instant) or in an overlap (two, so none); hour-long shifts."""
    utc = F.to_utc_timestamp(local, zone)
    gap = F.from_utc_timestamp(utc, zone) != local
    hour = F.expr("interval 1 hour")
    twice = (F.from_utc_timestamp(utc + hour, zone) == local) | (F.from_utc_timestamp(utc - hour, zone) == local)
    state = F.when(gap, "gap").when(twice, "overlap").otherwise("exact")
    return F.struct(F.when(state == "exact", utc).alias("instant"), state.alias("state"))


def settled(parsed: Column, default_zone: str | None) -> Column:
    """A parsed deadline with zone source, precision, instant and status; a refused text, and a time in a daylight-saving gap, is ``rejected`` and has a reason alone."""

    def placed(p: Column) -> Column:
        review = p["review"]
        unusable = F.array_contains(review, "unrecognised_timezone") | F.array_contains(review, "conflicting_timezone")
        source = F.when(p["zone"].isNotNull(), STATED).when(F.lit(default_zone is not None) & ~unusable, DEFAULT).otherwise(UNKNOWN)
        zone = F.when(p["zone"].isNotNull(), p["zone"]).when(~unusable, F.lit(default_zone))
        local = F.try_to_timestamp(F.concat(p["date"].cast("string"), F.lit(" "), p["time"]), F.lit("yyyy-MM-dd HH:mm"))
        at = local_instant(local, F.coalesce(zone, F.lit("UTC")))
        return F.struct(p.alias("p"), unusable.alias("unusable"), source.alias("source"), zone.alias("zone"), at.alias("at"))

    def judged(x: Column) -> Column:
        p = x["p"]
        gap = p["time"].isNotNull() & x["zone"].isNotNull() & (x["at"]["state"] == "gap")
        return F.struct(x.alias("x"), F.when(p["reason"].isNotNull(), p["reason"]).when(gap, "nonexistent_local_time").alias("reason"))

    def one(y: Column) -> Column:
        x, reason = y["x"], y["reason"]
        p, zone, at = x["p"], x["zone"], x["at"]
        fine = reason.isNull()
        timed = p["time"].isNotNull() & zone.isNotNull()
        missing = F.when(p["time"].isNotNull() & zone.isNull() & ~x["unusable"], F.lit("missing_timezone"))
        twice = F.when(timed & (at["state"] == "overlap"), F.lit("ambiguous_local_time"))
        reasons = F.when(fine, F.concat(p["review"], F.array_compact(F.array(missing, twice)))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.struct(
            F.when(fine, p["date"]).alias("date"),
            F.when(fine, p["time"]).alias("time"),
            F.when(fine, zone).alias("zone"),
            F.when(fine, x["source"]).alias("zone_source"),
            F.when(fine, F.when(p["time"].isNull(), "date").otherwise("datetime")).alias("precision"),
            F.when(fine & timed, at["instant"]).alias("instant"),
            reason.alias("reason"),
            F.when(~fine, "rejected").when(F.size(reasons) > 0, "needs_review").otherwise("verified").alias("status"),
            reasons.alias("review"),
        )

    return _bound(_bound(_bound(parsed, placed), judged), one)
