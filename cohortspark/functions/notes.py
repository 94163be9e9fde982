"""Radiology notes: sections, protected information, hedging language."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Section patterns in order of precedence.
SECTION_START = [r"(?i)impression:", r"(?i)impression[:;]", r"(?i)impresssion:", r"(?i)conclusion[:;]", r"(?i)  1\.", r"(?i) : 1\."]
FINDINGS_START = [r"(?i)findings[:;]"]
SECTION_END = [r"(?i)end (of )*impression( summary)*[:.]*|summary( code)*[:.]", r"(?i)summary code [0-9]|i have personally reviewed"]

# Date and time patterns.
YEAR, DAY, MONTH_NO = r"(?:19[0-9]{2}|20[012][0-9])", r"(?:3[01]|[12][0-9]|0*[1-9])", r"(?:1[012]|0*[1-9])"
CLOCK = r"[0-2]*[0-9]:[0-5][0-9](?::[0-5][0-9])*(?:\s*(?:[ap]m|[ap]\.m\.))*"
MONTH = r"(?:january|february|march|april|may|june|july|august|september|october|november|december|(?:jan|feb|mar|apr|may|june|jul|aug|sep|sept|oct|nov|dec)\.*)"
WEEKDAY = r"(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)"
NTH = r"(?:st|nd|rd|th)*"
TIMES = [
    rf"\b{MONTH}\b",
    rf"\b{WEEKDAY}\b",
    CLOCK,
    rf"\b{MONTH}\s*{YEAR}\b",
    rf"\b{YEAR}\b",
    rf"(?:{MONTH_NO}-{DAY}-{YEAR}|{MONTH_NO}/{DAY}/{YEAR})(?:\s*{CLOCK})*",
    rf"(?:{YEAR}/{MONTH_NO}/{DAY}|{YEAR}-{MONTH_NO}-{DAY})(?:\s*{CLOCK})*",
    r"\b(?:1[0-9]|0[1-9])/[0-3][0-9]\b",
    rf"\b(?:mid-)*(?:{YEAR}|the [2-9]0)s\b",
    rf"\b(?:{MONTH_NO}-{DAY}-[012][0-9]|{MONTH_NO}/{DAY}/[012][0-9])(?:\s*{CLOCK})*\b",
    rf"{MONTH}-{DAY}-{YEAR}(?:\s*{CLOCK})*",
    rf"(?:{MONTH} of {YEAR}|{YEAR} in {MONTH})",
    rf"{MONTH} *{DAY}{NTH}[, ]*{YEAR}",
    rf"{DAY}{MONTH}{YEAR}",
    rf"{DAY}{NTH} of {MONTH}(?:\s{YEAR})*",
    rf"\b{MONTH} {DAY}{NTH}\b",
]
#: Where each of these can begin: m at a month, n at one if there are digits at all, w at a weekday, 9 at a digit, d at a digit or
#: a decade, b at a digit or a month.
TIMES_BEGIN = "mw9n9999d9nbn99n"
# Names, pagers, hours, stopwords, hedges.
_AFTER_NAME = "UPON|FROM|WITH|WAS|AND|VIA|AS|TO|AT|BY|IN|OF|ON"
#: A name's word, which may have inner capitals, after initials and particles ("A. B. Jones", "de la Cruz").
_WORD_UPPER = rf"(?:(?:[A-Z]\.\s*|(?:DE|DEL|DER|DEN|DI|DA|LA|LE|VAN|VON)\s+)*(?!(?:{_AFTER_NAME})\b)[A-Z][A-Z'-]+\b)"
_WORD_TITLE = r"(?:(?:[A-Z]\.\s*|(?:de|del|der|den|di|da|la|le|van|von|De|Del|La|Le|Van|Von)\s+)*[A-Z][A-Za-z'-]+\b)"
#: Up to four whole words before such a word or a mark; or else the word after the title alone.
NAME_UPPER = rf"\bDR\.*\s+(?:{_WORD_UPPER}(?:\s+{_WORD_UPPER}){{0,3}}(?=\s+(?:{_AFTER_NAME})\b|\s*[@.,;()])|{_WORD_UPPER}|(?!(?:{_AFTER_NAME})\b)[A-Z'-]+\b)"
#: Up to four capitalised words.
NAME_TITLE = rf"\bDr\.*\s+{_WORD_TITLE}(?:\s+{_WORD_TITLE}){{0,3}}"
PAGERS, HOURS = [r"PAGER [0-9-]+\b"], [r"[0-9]{3,4}\s*HOURS", r"(?<=AT )[0-9]{3,4}"]
STOPWORDS = {"may"}
HEDGES = {
    "diagnostic_uncertainty": r"\b(cannot (be )?exclude|cannot (be )?rule(d)? out|equivocal|indeterminate|borderline|inconclusive|unclear|uncertain|non-diagnostic)\b",
    "technical_artifact": r"\b(motion artifact|breathing artifact|breathing motion|limited study|suboptimal (enhancement|opacification|contrast|visualization)|poor (contrast|opacification|enhancement)|streak artifact)\b",
    "anatomical_differential": r"\b(subsegmental|artifact vs|filling defect vs|chronic vs acute|acute vs chronic|residual vs|thrombus vs|clot vs)\b",
    "probabilistic_hedging": r"\b(possible|suspected|questionable|concerning for|evaluated? for|suggestive of|may represent)\b",
}


def _first_match(text: Column, patterns: list[str]) -> Column:
    """Where the first pattern that matches at all does so, from 1; null if none does. One scan a pattern."""
    return F.coalesce(*(F.nullif(F.regexp_instr(text, F.lit(p)), F.lit(0)) for p in patterns))


def section(text: Column, strict: bool = True) -> Column:
    """The impression section, up to the first end mark in it or the note's end. Without one: null, or, not strict, from the
    findings, or else the whole note."""
    start = _first_match(text, SECTION_START)
    if not strict:
        start = F.coalesce(start, _first_match(text, FINDINGS_START), F.lit(1))
    # what follows the start is made once, so no pattern is searched for twice; a mark before the start ends nothing
    rest = F.transform(F.array(start), lambda s: F.substring(text, s, F.length(text)))
    return F.element_at(F.transform(rest, lambda r: F.substring(r, F.lit(1), F.coalesce(_first_match(r, SECTION_END) - 1, F.length(r)))), 1)


def with_section(df: DataFrame, note: str, name: str = "section", strict: bool = True) -> DataFrame:
    """df with the section of its notes; rows whose section is missing or blank go. The section is cut by a generator, since a
    filter after a projection would search every note twice."""
    said = F.filter(F.array(section(F.col(note), strict)), lambda s: F.trim(F.translate(s, "\t\r\n", "   ")) != "")
    return df.withColumn(name, F.explode(said))


def without_phrases(text: Column, phrases: list[str]) -> Column:
    """The text without fixed phrases and with spaces for line ends."""
    for p in phrases:
        text = F.replace(text, F.lit(p), F.lit(""))
    return F.regexp_replace(text, r"[\r\n]+", " ")


def hedges(text: Column) -> Column:
    """(is_hedged, match_count, categories) of a text; null is none."""
    n = {k: F.coalesce(F.regexp_count(text, F.lit(f"(?i){p}")), F.lit(0)) for k, p in HEDGES.items()}
    total = sum(list(n.values())[1:], list(n.values())[0])
    kinds = F.filter(F.array(*(F.when(c > 0, F.lit(k)) for k, c in n.items())), lambda x: x.isNotNull())
    return F.struct((total > 0).alias("is_hedged"), total.alias("match_count"), kinds.alias("categories"))


_RUN = re.compile(r"\w+")


class Names:
    """A dictionary of names as sorted numbers and one string of bytes: about 30 bytes for a name of 18 letters. A text is read
    once however many names there are.

    A name that stands as whole words has whole runs of word characters, so it is looked up by the number of all from its first
    run to its last one, as is each sequence of as many runs of a text; the name itself is compared then.
    """

    def __init__(self, names: Iterable[str]):
        whole = {lowered(n.strip()) for n in names if n and n.strip()}
        self.bare = sorted(n for n in whole if not _RUN.search(n))
        rows, counts = [], set()
        for n in whole:
            if runs := [m.span() for m in _RUN.finditer(n)]:
                rows.append((_number(n[runs[0][0] : runs[-1][1]]), n))
                counts.add(len(runs))
        rows.sort()
        said = [_bytes(n) for _, n in rows]
        self.counts, self.keys = sorted(counts), np.array([k for k, _ in rows], np.uint32)
        self.ends, self.said = np.cumsum([0, *map(len, said)]), b"".join(said)

    def found(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of all names in any case that stand as whole words, those inside others, too."""
        low, spans = lowered(text), []
        for n in self.bare:
            a = low.find(n)
            while a >= 0:
                spans.append((a, a + len(n)))
                a = low.find(n, a + 1)
        runs = [m.span() for m in _RUN.finditer(text)] if self.counts else []
        for count in self.counts:
            numbers = np.fromiter((_number(low[a:b]) for (a, _), (_, b) in zip(runs, runs[count - 1 :])), np.uint32)
            first = np.searchsorted(self.keys, numbers)
            for i in np.flatnonzero(self.keys[np.minimum(first, len(self.keys) - 1)] == numbers):
                for k in range(first[i], np.searchsorted(self.keys, numbers[i], "right")):
                    n = self.said[self.ends[k] : self.ends[k + 1]].decode("utf-8", "surrogatepass")
                    core = [m.span() for m in _RUN.finditer(n)]
                    a = runs[i][0] - core[0][0]
                    if len(core) == count and a >= 0 and low.startswith(n, a):
                        spans.append((a, a + len(n)))
        return sorted(spans)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _number(text: str) -> int:
    return zlib.crc32(_bytes(text))


def lowered(text: str) -> str:
    """In lower case, character by character: those that would become several stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


_DIGIT, _FOLDED = re.compile("[0-9]"), re.compile("\u017f|\u212a")


def beginnings(text: str) -> dict[str, list[int]]:
    """Where patterns can begin, in order. The keys are those of TIMES_BEGIN, and D (titles) and P (pagers)."""
    low = lowered(_FOLDED.sub(lambda m: "s" if m[0] == "\u017f" else "k", text))  # letters that match s and k in any case

    def at(*words: str, of: str = low) -> list[int]:
        out = []
        for w in words:
            a = of.find(w)
            while a >= 0:
                out.append(a)
                a = of.find(w, a + 1)
        return sorted(out)

    digits, months = [m.start() for m in _DIGIT.finditer(text)], at("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
    decades = sorted({*digits, *at("mid-"), *(d - 4 for d in digits if low[d - 4 : d] == "the ")})
    weekdays = at("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    return {"9": digits, "m": months, "b": sorted(digits + months) if digits else [], "w": weekdays, "d": decades, "D": at("DR", "Dr", of=text), "P": at("pager "), "n": months if digits else []}


def matches(pattern: re.Pattern, text: str, places: list[int]) -> Iterator[re.Match]:
    """Those of pattern.finditer(text), which all begin at one of the places."""
    end = 0
    for a in places:
        if a >= end and (m := pattern.match(text, a)):
            end = m.end()
            yield m


class Tagger:
    """Spans (start, end, kind) of protected information in a text.

    A pattern is tried only where it can begin: at a digit, a month, a weekday, a decade, a title or a pager. These places are
    found once a text, by searches for fixed strings, so most of a text is read by no pattern.
    """

    def __init__(self):
        begin = lambda ps, starts: [(re.compile(p, re.I), s) for p, s in zip(ps, starts, strict=True)]
        people = [(re.compile(NAME_UPPER), "D"), (re.compile(NAME_TITLE), "D")]
        self.kinds = [("person", people), ("timex", begin(TIMES, TIMES_BEGIN)), ("pager", begin(PAGERS, "P")), ("hours", begin(HOURS, "99"))]

    def spans(self, text: str, names: list[tuple[int, int]] = ()) -> list[tuple[int, int, str]]:
        """In order, with those of names found before; overlapping and touching spans of any kinds are one, of the kind that begins first."""
        found, places = [(a, b, 0, "person") for a, b in names], beginnings(text)
        for rank, (kind, patterns) in enumerate(self.kinds):
            for p, begin in patterns:
                found += [(m.start(), m.end(), rank, kind) for m in matches(p, text, places[begin]) if m[0].lower().strip() not in STOPWORDS]
        out: list[list] = []
        for start, end, _, kind in sorted(found, key=lambda x: (x[0], x[2], -x[1])):
            if out and start <= out[-1][1]:
                out[-1][1] = max(out[-1][1], end)
            else:
                out.append([start, end, kind])
        for s in out:
            while s[1] > s[0] and text[s[1] - 1] == " ":
                s[1] -= 1
        return [tuple(s) for s in out if s[1] > s[0]]

    def replaced(self, text: str, names: list[tuple[int, int]] = ()) -> str:
        for start, end, kind in reversed(self.spans(text, names)):
            shown = re.sub(r"\s+", " ", placeholder(text[start:end], kind)).upper()
            text = text[:start] + shown + text[end:]
        return text


def placeholder(mention: str, kind: str) -> str:
    """What stands for a mention: names by how many words they have, times with X for digits and words for their parts."""
    if kind == "person":
        title = re.match(r"dr\.*|physician", mention, re.I)
        words = mention[title.end() :].split() if title else mention.split()
        name = "LAST_NAME" if title and len(words) == 1 else "FIRST_NAME LAST_NAME" if len(words) > 1 and (title or len(words) == 2) else "NAME"
        return f"<PERSON>{title[0] + ' ' if title else ''}{name}</PERSON>"
    x = re.sub(r"\d", "X", mention)
    if kind == "timex":
        for pattern, word in ((r"\b[ap]\.m\.|(?<![a-z])[ap]m\b", "AM_PM"), (MONTH, "MONTH"), (rf"{WEEKDAY}|\b(?:mon|tue|wed|thu|fri|sat|sun)\b\.*", "DAY")):
            x = re.sub(pattern, word, x, flags=re.I)
        x = re.sub(r"X(?:st|nd|rd|th)\b", "X", x, flags=re.I)
    tag = "PAGER" if kind == "pager" else "TIMEX3"
    return f"<{tag}>{x.strip()}</{tag}>"


#: Names that are broadcast together; a table with more makes several parts, which notes pass one after the other.
MOST_NAMES = 1_000_000


def dictionary(names: DataFrame, name: str = "name", most: int = MOST_NAMES) -> list[Broadcast]:
    """The distinct names of a table, in parts of about `most` by their hashes, each broadcast once (a list of Names; empty
    without names)."""
    spark = names.sparkSession
    distinct = names.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    parts = max(1, -(-distinct.count() // most))
    part = F.pmod(F.xxhash64("name"), F.lit(parts))
    packed = lambda rows: [Names(r.name for r in rows)] if rows else []
    return [spark.sparkContext.broadcast(packed(distinct.where(part == k).collect())) for k in range(parts)]


def name_spans(c: str, names: list[Broadcast]) -> Column:
    """Spans of the names of dictionary() as array<struct<start, end>>, in order; null text gives null."""
    columns = [_tagged(c, part) for part in names]
    return columns[0] if len(columns) == 1 else F.array_sort(F.concat(*columns))


def _tagged(c: str, part: Broadcast) -> Column:
    @F.pandas_udf("array<struct<start: int, end: int>>")
    def tag(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"start": a, "end": b} for known in part.value for a, b in known.found(t)] for t in texts], dtype=object)

    return tag(F.col(c))


def phi_spans(c: str, names: list[Broadcast] = ()) -> Column:
    """Spans of protected information as array<struct<start, end, type>>; null text gives null. names: of dictionary()."""
    tagger = Tagger()

    @F.pandas_udf("array<struct<start: int, end: int, type: string>>")
    def tag(texts: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"start": a, "end": b, "type": k} for a, b, k in tagger.spans(t, pairs(n))] for t, n in zip(texts, known)], dtype=object)

    return tag(F.col(c), _known(c, names))


def anonymized(c: str, names: list[Broadcast] = ()) -> Column:
    """The text with placeholders for protected information, replaced where it stands, from right to left. names: of dictionary()."""
    tagger = Tagger()

    @F.pandas_udf("string")
    def replace(texts: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else tagger.replaced(t, pairs(n)) for t, n in zip(texts, known)], dtype=object)

    return replace(F.col(c), _known(c, names))


def _known(c: str, names: list[Broadcast]) -> Column:
    return name_spans(c, names) if names else F.lit(None).cast("array<struct<start: int, end: int>>")


def pairs(spans) -> list[tuple[int, int]]:
    return [] if spans is None else [(s["start"], s["end"]) for s in spans]
