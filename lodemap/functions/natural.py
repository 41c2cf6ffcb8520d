"""Dates as people write them, as columns: names of months in several languages, and moments relative to another one."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months by number (English, German, French, Spanish, Italian, Portuguese, Dutch), and three letters of each.
MONTHS = (
    ("january", "januar", "jänner", "janvier", "enero", "gennaio", "janeiro", "januari", "jan", "janv", "ene", "gen"),
    ("february", "februar", "février", "fevrier", "febrero", "febbraio", "fevereiro", "februari", "feb", "févr", "fev"),
    ("march", "märz", "mars", "marzo", "março", "maart", "mar", "mär", "mrt"),
    ("april", "avril", "abril", "aprile", "apr", "avr", "abr"),
    ("may", "mai", "mayo", "maggio", "maio", "mei", "mag"),
    ("june", "juni", "juin", "junio", "giugno", "junho", "jun", "giu"),
    ("july", "juli", "juillet", "julio", "luglio", "julho", "jul", "juil", "lug"),
    ("august", "août", "aout", "agosto", "augustus", "aug", "ago"),
    ("september", "septembre", "septiembre", "settembre", "setembro", "sep", "sept", "set"),
    ("october", "oktober", "octobre", "octubre", "ottobre", "outubro", "oct", "okt", "ott", "out"),
    ("november", "novembre", "noviembre", "novembro", "nov"),
    ("december", "dezember", "décembre", "decembre", "diciembre", "dicembre", "dezembro", "dec", "dez", "déc", "dic"),
)
# Single words and the days they are away; units of time.
DAYS = {
    "today": 0, "now": 0, "yesterday": -1, "tomorrow": 1, "heute": 0, "gestern": -1, "morgen": 1, "aujourd'hui": 0, "hier": -1, "demain": 1, "hoy": 0, "ayer": -1, "mañana": 1,
    "oggi": 0, "ieri": -1, "domani": 1, "hoje": 0, "ontem": -1, "amanhã": 1,
}
UNITS = {
    "years": ("year", "years", "jahr", "jahre", "jahren", "an", "ans", "année", "années", "año", "años"),
    "months": ("month", "months", "monat", "monate", "monaten", "mois", "mes", "meses"),
    "weeks": ("week", "weeks", "woche", "wochen", "semaine", "semaines", "semana", "semanas"),
    "days": ("day", "days", "tag", "tage", "tagen", "jour", "jours", "día", "días", "dia", "dias"),
    "hours": ("hour", "hours", "stunde", "stunden", "heure", "heures", "hora", "horas"),
    "mins": ("minute", "minutes", "min", "mins", "minuten", "minuto", "minutos"),
    "secs": ("second", "seconds", "sec", "secs", "sekunde", "sekunden", "seconde", "secondes", "segundo", "segundos"),
}
CLOCK = r"(?: (?:at |um |à )?(\d{1,2}):(\d{2})(?::(\d{2}))?)?$"
LINK = r"(?: (?:of|de|del|den))?"
DAY_FIRST = rf"^(?:\p{{L}}+ )?(?:le |el |am )?(\d{{1,2}})(?:st|nd|rd|th|er|º|ª)?{LINK} (\p{{L}}+){LINK} (\d{{4}}){CLOCK}"
MONTH_FIRST = rf"^(?:\p{{L}}+ )?(\p{{L}}+) (\d{{1,2}})(?:st|nd|rd|th)? (\d{{4}}){CLOCK}"
COUNT = r"(\d{1,5}|an?|one|ein(?:em|er)?|une?)"
BEFORE = (rf"^{COUNT} (\p{{L}}+) ago$", rf"^(?:il y a|vor|hace) {COUNT} (\p{{L}}+)$")
AFTER = (rf"^in {COUNT} (\p{{L}}+)$", rf"^(?:dans|en) {COUNT} (\p{{L}}+)$")
NEXT = (r"^(?:last|previous) (\p{L}+)$", r"^next (\p{L}+)$")


def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two moments, never below 0."""
    return F.greatest(F.lit(0), F.timestamp_diff("MILLISECOND", start, end))


def after(moment: Column, duration: Column) -> Column:
    """The moment after a duration such as ``30d``, ``12h`` or ``4w``; null if it isn't written so."""
    text = F.lower(F.trim(duration))
    n, unit = F.regexp_extract(text, r"^(\d{1,6})([hdw])$", 1).try_cast("int"), F.substring(text, -1, 1)
    part = lambda u: F.when(unit == u, n).otherwise(0)
    return F.when(text.rlike(r"^\d{1,6}[hdw]$"), moment + F.make_interval(weeks=part("w"), days=part("d"), hours=part("h")))


def in_words(cell: Column) -> Column:
    """Whether a cell may name a moment in words: one test, for columns of which few do."""
    told = "|".join([*(p.removeprefix("^").removesuffix("$") for p in (DAY_FIRST, MONTH_FIRST, *BEFORE, *AFTER, *NEXT)), *DAYS])
    return F.regexp_replace(F.lower(cell), r"[,.]? +|[,.]$", " ").rlike(rf"^ *(?:{told}) *$")


def _looked_up(table: dict[str, object], word: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), word)


def _dated(text: Column, pattern: str, places: tuple[int, int, int]) -> Column:
    day, month, year = (F.regexp_extract(text, pattern, k) for k in places)
    number = _looked_up({n: i for i, names in enumerate(MONTHS, 1) for n in names}, month)
    clock = [F.coalesce(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")), F.lit("0")) for k in (4, 5, 6)]
    written = F.concat_ws(" ", F.concat_ws("-", year, number.cast("string"), day), F.concat_ws(":", *clock))
    return F.when(text.rlike(pattern) & number.isNotNull(), F.try_to_timestamp(written, F.lit("yyyy-M-d H:m:s")).cast("timestamp_ntz"))


def _moved(text: Column, pattern: str, sign: int, now: Column, counted: bool = True) -> Column:
    count = F.regexp_extract(text, pattern, 1) if counted else F.lit("1")
    n = sign * F.coalesce(count.try_cast("int"), F.lit(1))
    unit = _looked_up({w: u for u, words in UNITS.items() for w in words}, F.regexp_extract(text, pattern, 2 if counted else 1))
    by = F.make_interval(*[F.when(unit == u, n).otherwise(0) for u in ("years", "months", "weeks", "days", "hours", "mins", "secs")])
    return F.when(text.rlike(pattern) & unit.isNotNull(), now + by)


def natural_date(cell: Column, now: Column) -> Column:
    """The moment that a cell names in words, as a timestamp without zone; null if it names none.

    ``3 mars 2024``, ``March 3rd, 2024 14:05``, ``den 3. März 2024``; and, from ``now``
    on, ``yesterday``, ``2 weeks ago``, ``in 3 Tagen``, ``il y a 2 mois``, ``next year``.
    """
    at = now.cast("timestamp_ntz")
    text = F.trim(F.regexp_replace(F.regexp_replace(F.lower(cell), r"[,.]", " "), r"\s+", " "))
    day = _looked_up(dict(DAYS), text)
    found = [
        _dated(text, DAY_FIRST, (1, 2, 3)),
        _dated(text, MONTH_FIRST, (2, 1, 3)),
        F.when(day.isNotNull(), at + F.make_interval(days=day)),
        *[_moved(text, p, -1, at) for p in BEFORE],
        *[_moved(text, p, 1, at) for p in AFTER],
        *[_moved(text, p, sign, at, False) for p, sign in zip(NEXT, (-1, 1))],
    ]
    return F.when(cell.rlike(r"\p{L}"), F.coalesce(*found))
