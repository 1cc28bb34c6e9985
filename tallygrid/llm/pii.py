"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust scores.

Everything is a DataFrame expression. A pattern cuts a text into matches and the pieces between
them; lengths of both, summed from the left, give the spans. The sums are taken in log2(n) passes over the
array, so a text with very many matches costs n log n. The 40 characters before a match and the 20 after it
are those of the text, other matches included, put together from neighbouring pieces and matches in at most six
doubling steps, so nothing scans the whole text once per match.

The four base kinds (e-mail, IP, card, phone) are kept whenever their check passes; context only
changes their score. The added kinds (IBAN, national number, secret) are kept if the score reaches
``THRESHOLD``. An IBAN may be followed by capitals or numbers that look like more of it: it ends at the last blank, or at
the end of all, where its check passes, and the search goes on behind it. Spans count code points, the end is exclusive; spans of one kind never overlap, spans of two kinds may.

Java's engine runs repeated groups by recursion and would try a failed run again at each of its
characters. The patterns therefore take possessive repeats (nothing that follows could use what they
would give back) and start a run only at its first character or at the end of the match before. Both leave the
matches as they are.

Defined cases: a null or empty text has no spans; repeated rows are judged each by itself; an empty
table gives an empty result; other columns are kept by ``redact`` and ignored by ``find``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

THRESHOLD = 0.6
CONTEXT_BEFORE, CONTEXT_AFTER = 40, 20


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a text pass the Luhn check."""
    back = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(back, i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN passes its check: moved by four, letters as numbers, remainder 1."""
    plain = F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", ""))
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(moved, i, F.lit(1)))
        number = F.when(code >= 65, code - 55).otherwise(code - 48)
        return (rest * F.when(number > 9, 100).otherwise(10) + number) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def _ip_parts(value: Column) -> Column:
    small = lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.substring(part, -3, 3)).cast("int") <= 255)
    return F.forall(F.split(value, r"\."), small)


def _length_between(least: int, most: int) -> Callable[[Column], Column]:
    return lambda value: F.length(_digits(value)).between(least, most)


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. ``needs``: a pattern without which a text has no match (cheap to look for).
    ``shortest``: if set, ``pattern`` takes only the beginning of a match and its group sees the most that may follow;
    the match is the longest part, up to a blank or the end, that has so many characters besides blanks and passes ``check``."""

    name: str
    pattern: str
    needs: str
    check: Callable[[Column], Column]
    score: float
    context: str
    base: bool = False
    shortest: int = 0


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         lambda v: F.lit(True), 0.9, "mail|contact|write|kontakt|correo|courriel", True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", _ip_parts, 0.7, r"\bip\b|host|server|address|adresse", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9][\\x20-]?[0-9]", lambda v: _length_between(13, 19)(v) & luhn(v), 0.8,
         "card|visa|mastercard|payment|karte|tarjeta|carte", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", _length_between(9, 15), 0.7, "call|phone|tel|mobile|fax|whatsapp", True),
    Kind("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9_]))", "[A-Z]{2}[0-9]{2}", mod97, 0.8,
         "iban|account|konto|cuenta|compte", shortest=15),
    Kind("national_id", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]",
         lambda v: F.lit(True), 0.4, "ssn|social security|insurance|national"),
    Kind("secret", r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,64}(?![A-Za-z0-9])", "[A-Fa-f0-9]{32}", lambda v: F.lit(True), 0.4, "token|secret|key|passw|credential|auth"),
)
CONTEXT_BONUS = 0.3


def running_sums(values: Column) -> Column:
    """Sums of an array from its start up to each place, by doubling steps."""
    return _running(values, lambda a, b: a + b)


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """An array of numbers of at least 0, combined from its start up to each place; 0 changes nothing."""
    size = F.size(values)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(2)))).cast("int") - 1)

    def double(sums: Column, step: Column) -> Column:
        shift = F.least(F.pow(F.lit(2), step).cast("int"), F.size(sums))
        moved = F.concat(F.array_repeat(F.lit(0), shift), F.slice(sums, F.lit(1), F.size(sums) - shift))
        return F.zip_with(sums, moved, combine)

    return F.when(size <= 1, values).otherwise(F.aggregate(steps, values, double))


def _lengths(pieces: Column, found: Column) -> Column:
    """For each match, the length of the piece before it and of the match before that."""
    earlier = F.concat(F.array(F.lit("")), F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))))
    return F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), earlier, lambda piece, match: F.coalesce(F.length(piece), F.lit(0)) + F.length(match))


def _with_cut(frame: DataFrame, text: Column, kind: Kind, name: str) -> DataFrame:
    """The frame with a column ``struct<pieces, found>``: the matches of a kind and the pieces around them."""
    has = text.rlike(kind.needs)
    none = F.array().cast("array<string>")
    pieces = F.when(has, F.split(text, kind.pattern, -1)).otherwise(none)
    found = F.when(has, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))).otherwise(none)
    if not kind.shortest:
        return frame.withColumn(name, F.struct(pieces.alias("pieces"), found.alias("found")))
    heads, chosen, segments = F.col(f"{name}_heads"), F.col(f"{name}_chosen"), F.col(f"{name}_segments")
    rest = F.when(has, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1))).otherwise(none)
    frame = frame.withColumn(f"{name}_heads", F.struct(pieces.alias("pieces"), found.alias("found"), rest.alias("rest")))
    frame = frame.withColumn(f"{name}_starts", running_sums(_lengths(heads["pieces"], heads["found"])))

    def longest(start: Column, most: Column) -> Column:
        words = F.split(most, " ")
        parts = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
        passed = F.filter(parts, lambda v: (F.length(F.replace(v, F.lit(" "), F.lit(""))) >= kind.shortest) & kind.check(v))
        return F.struct(start.alias("start"), F.get(passed, F.lit(0)).alias("value"))

    # ``at`` is the place among all beginnings
    most = F.zip_with(heads["found"], heads["rest"], lambda head, tail: F.concat(head, tail))
    tried = F.zip_with(F.col(f"{name}_starts"), most, longest)
    tried = F.transform(tried, lambda m, i: F.struct((i + 1).alias("at"), m["start"].alias("start"), m["value"].alias("value")))
    frame = frame.withColumn(f"{name}_tried", F.filter(tried, lambda m: m["value"].isNotNull()))

    def add(kept: Column, m: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        free = F.coalesce(m["start"] >= last["start"] + F.length(last["value"]), F.lit(True))
        return F.when(free, F.concat(kept, F.array(m))).otherwise(kept)

    # those that overlap are rare, and only then the first has to be chosen one by one
    tried = F.col(f"{name}_tried")
    overlap = F.exists(
        F.zip_with(F.slice(tried, F.lit(1), F.greatest(F.size(tried) - 1, F.lit(0))), F.slice(tried, F.lit(2), F.size(tried)), lambda a, b: a["start"] + F.length(a["value"]) > b["start"]),
        lambda late: late,
    )
    no_match = F.array().cast("array<struct<at: int, start: int, value: string>>")
    frame = frame.withColumn(f"{name}_chosen", F.when(overlap, F.aggregate(tried, no_match, add)).otherwise(tried))
    # each beginning with the text up to the next one, and where it starts
    texts = F.zip_with(heads["found"], F.slice(heads["pieces"], F.lit(2), F.size(heads["found"])), lambda head, piece: F.concat(head, piece))
    frame = frame.withColumn(f"{name}_segments", F.zip_with(F.col(f"{name}_starts"), texts, lambda start, t: F.struct(start.alias("start"), t.alias("text"))))

    def behind(m: Column, then: Column) -> Column:
        """The text from the end of a chosen match to the next one."""
        end, until = m["start"] + F.length(m["value"]), F.coalesce(then["at"], F.size(segments) + 1)
        parts = F.slice(segments, m["at"], until - m["at"])
        return F.array_join(F.transform(parts, lambda s: F.substring(s["text"], F.greatest(end - s["start"], F.lit(0)) + 1, F.length(s["text"]))), "")

    first = F.concat(F.get(heads["pieces"], F.lit(0)), F.array_join(F.transform(F.slice(segments, F.lit(1), F.get(chosen, F.lit(0))["at"] - 1), lambda s: s["text"]), ""))
    after = F.zip_with(chosen, F.slice(chosen, F.lit(2), F.size(chosen)), behind)
    some = F.size(chosen) > 0
    made = F.struct(
        F.when(some, F.concat(F.array(first), after)).otherwise(none).alias("pieces"),
        F.when(some, F.transform(chosen, lambda m: m["value"])).otherwise(none).alias("found"),
    )
    return frame.withColumn(name, made).drop(*[f"{name}_{part}" for part in ("heads", "starts", "tried", "chosen", "segments")])


def _doubled(parts: Column, length: int, ahead: bool) -> Column:
    """What stands before each place of an array of texts, its own text included (``ahead``: from its own text on), up to ``length`` characters.
    Each text but an outermost one has at least one character, so neighbours at a distance of ``length`` say all."""
    cut = (lambda t: F.substring(t, 1, length)) if ahead else (lambda t: F.substring(t, -length, length))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.least(F.greatest(F.size(parts), F.lit(2)), F.lit(length)))).cast("int") - 1)

    def double(texts: Column, step: Column) -> Column:
        shift = F.least(F.pow(F.lit(2), step).cast("int"), F.size(texts))
        blank = F.array_repeat(F.lit(""), shift)
        moved = F.concat(F.slice(texts, shift + 1, F.size(texts)), blank) if ahead else F.concat(blank, F.slice(texts, F.lit(1), F.size(texts) - shift))
        return F.zip_with(texts, moved, lambda own, other: cut(F.concat(own, other) if ahead else F.concat(other, own)))

    return F.aggregate(steps, F.transform(parts, cut), double)


def _context(cut: Column) -> tuple[Column, Column]:
    """The text before and after each match of a cut, as far as context reaches."""
    pieces, found = cut["pieces"], cut["found"]
    size = F.size(found)
    earlier = F.concat(F.array(F.lit("")), F.slice(found, F.lit(1), F.greatest(size - 1, F.lit(0))))
    later = F.concat(F.slice(found, F.lit(2), size), F.array(F.lit("")))
    before = F.zip_with(earlier, F.slice(pieces, F.lit(1), size), lambda match, piece: F.concat(match, piece))
    after = F.zip_with(F.slice(pieces, F.lit(2), size), later, lambda piece, match: F.concat(piece, match))
    return _doubled(before, CONTEXT_BEFORE, False), _doubled(after, CONTEXT_AFTER, True)


def _score(kind: Kind, before: Column, after: Column) -> Column:
    near = F.lower(F.concat_ws(" ", before, after)).rlike(kind.context)
    return F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, CONTEXT_BONUS).otherwise(0.0))


def _spans(cut: Column, kind: Kind, starts: Column) -> Column:
    """``array<struct<kind, start, end, value, score>>`` of the matches that pass, in order."""
    before, after = _context(cut)
    each = F.arrays_zip(starts.alias("start"), cut["found"].alias("value"), before.alias("before"), after.alias("after"))
    passed = F.filter(each, lambda m: kind.check(m["value"]))
    spans = F.transform(
        passed,
        lambda m: F.struct(
            F.lit(kind.name).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"),
            m["value"].alias("value"), _score(kind, m["before"], m["after"]).alias("score"),
        ),
    )
    return spans if kind.base else F.filter(spans, lambda s: s["score"] >= THRESHOLD)


NO_SPANS = "array<struct<kind: string, start: int, end: int, value: string, score: double>>"


def _with_spans(frame: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """The frame (which has ``_text`` and no column named after a kind) with an array ``<kind>`` of spans for each kind."""
    columns = frame.columns
    for kind in kinds:
        frame = _with_cut(frame, F.col("_text"), kind, f"_{kind.name}")
    cuts = {kind: F.col(f"_{kind.name}") for kind in kinds}
    frame = frame.withColumns({f"_{kind.name}_lengths": _lengths(cut["pieces"], cut["found"]) for kind, cut in cuts.items()})
    frame = frame.withColumns({f"_{kind.name}_starts": running_sums(F.col(f"_{kind.name}_lengths")) for kind in kinds})
    spans = [
        F.when(F.size(cut["found"]) > 0, _spans(cut, kind, F.col(f"_{kind.name}_starts"))).otherwise(F.array().cast(NO_SPANS)).alias(kind.name)
        for kind, cut in cuts.items()
    ]
    return frame.select(*columns, *spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``doc_id`` and, for each kind, an array ``<kind>`` of its spans with value and score, in order of start."""
    frame = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return _with_spans(frame, kinds).drop("_text")


def span_texts(spans: Column) -> Column:
    """``kind:start:end`` of every span of an array."""
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))


#: characters of the parts that a text is put together from again
PART_CHARS = 1_000


def _merged(spans: Column) -> Column:
    """``array<struct<start, end, kind>>`` that covers the same characters as spans in order of start, without overlap."""
    size = F.size(spans)
    reach = _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    opens = F.zip_with(spans, F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), size - 1)), lambda s, before: s["start"] >= before)
    # a group ends where the next one opens, and the reach up to there is its end
    closes = F.concat(F.slice(opens, F.lit(2), size), F.array(F.lit(True)))
    heads = F.filter(F.arrays_zip(spans.alias("span"), opens.alias("mark")), lambda s: s["mark"])
    ends = F.filter(F.arrays_zip(reach.alias("end"), closes.alias("mark")), lambda s: s["mark"])
    return F.zip_with(heads, ends, lambda head, last: F.struct(head["span"]["start"].alias("start"), last["end"].alias("end"), head["span"]["kind"].alias("kind")))


def _between(parts: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end`` of a text cut into parts of ``PART_CHARS``; reads the parts in question alone."""
    first, last = F.floor(start / PART_CHARS).cast("int"), F.floor(end / PART_CHARS).cast("int")
    part = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    head = F.substring(part(first), start % PART_CHARS + 1, F.lit(PART_CHARS))
    middle = F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    within = F.substring(part(first), start % PART_CHARS + 1, end - start)
    return F.when(first == last, within).otherwise(F.concat(head, middle, F.substring(part(last), F.lit(1), end % PART_CHARS)))


def redact(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The documents with every span of ``find`` replaced by its kind in brackets, all other columns as they were.

    All kinds are judged on the text as it came. Spans that overlap are replaced together, by the kind of the one
    that starts first (of several, the longest; of those, the first in ``kinds``)."""
    columns = docs.columns
    frame = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    frame = _with_spans(frame, kinds)
    every = F.concat(*[
        F.transform(kind.name, lambda s, place=place: F.struct(s["start"].alias("start"), (-s["end"]).alias("_end"), F.lit(place).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
        for place, kind in enumerate(kinds)
    ])
    frame = frame.select("_row", "_text", F.array_sort(every).alias("_spans"))
    some = F.size("_spans") > 0
    frame = frame.withColumn("_merged", F.when(some, _merged(F.col("_spans")))).withColumn("_parts", F.when(some, F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{PART_CHARS}}}"), F.lit(0))))
    merged, parts = F.col("_merged"), F.col("_parts")
    starts = F.concat(F.array(F.lit(0)), F.transform(merged, lambda s: s["end"]))
    gaps = F.zip_with(starts, F.concat(F.transform(merged, lambda s: s["start"]), F.array(F.length("_text"))), lambda at, end: _between(parts, at, end))
    labels = F.concat(F.transform(merged, lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))), F.array(F.lit("")))
    made = F.array_join(F.zip_with(gaps, labels, lambda gap, label: F.concat(gap, label)), "")
    masked = F.when(some, made).otherwise(F.col(f"_row.`{text_col}`"))
    return frame.select(*[masked.alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in columns])
