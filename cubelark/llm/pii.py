"""Personal data: patterns propose, checksums confirm, nearby words adjust.

DataFrame functions only.  Each pattern is written so that a scan is linear in
the text: possessive repeats, and a look-behind that lets a run be entered only
at its start.  Documents without the character that every match of a kind needs
skip that kind's pattern.

The kinds of the base are reported whatever their score.  Of the added kinds the
score decides: a number of a form that many other numbers share, or an account
number of a country without a registered length, needs a word nearby that speaks
for it, and words that speak against it count, too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed: kinds of the base, in the order of the digest; what the method adds follows.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")

#: Fixed: what each kind looks like.  Runs are entered at their start only.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # the head matches; what may belong to it is looked at only, as the next head may begin in it
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}+[A-Za-z0-9]?+))",
    "ssn": r"(?<![A-Za-z0-9])(?<![0-9][.-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![A-Za-z0-9])(?![.-][0-9])",
}
#: Fixed: characters of an IBAN by country, as registered.  Of other countries every length is tried.
IBAN_CHARS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: A cheap test that every text with a match passes.
NEEDS = {"email": "@", "ip": None, "card": None, "phone": "+", "iban": None, "ssn": "-"}
#: Fixed: words that, close before a span, speak for its kind.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|address)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|bank|account|transfer|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social security|tax(?:payer)? id|itin)\b",
}
#: Fixed: words that, close before a span, speak against its kind.
AGAINST = {
    "iban": r"(?i)\b(?:example|sample|specimen|dummy)\b",
    "ssn": r"(?i)\b(?:order|part|invoice|serial|ticket|model|isbn|example|sample|dummy)\b",
}
#: Score of a span whose checksum or syntax holds (of an IBAN without a registered length the second), and
#: what words for and against it add and take.
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
UNREGISTERED_SCORE = 0.4
CONTEXT_BONUS = 0.3
CONTEXT_MALUS = 0.2
#: Code points before a match in which a context word counts.
CONTEXT_CHARS = 40
#: The least score at which a span of the added kinds is reported.  Base kinds are reported at any.
LEAST_SCORE = 0.5

#: Items that are folded into one array before it is put to the others, as an array that grows is copied at each step.
FOLDED = 64

SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"
MATCH = "struct<start:bigint,end:bigint,value:string,before:string>"


def _fold(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """All that `step` gives while it goes over `items`: step(state, item) is the next state and an array of `out`."""
    none = F.array().cast(f"array<{out}>")
    places = lambda n: F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / FOLDED).cast("int"), F.lit(0)))

    def one(acc: Column, item: Column) -> Column:
        state, more = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["out"], more).alias("out"))

    def chunk(acc: Column, own: Column) -> Column:
        start = F.struct(acc["state"].alias("state"), none.alias("out"))
        return F.aggregate(own, start, one, lambda inner: F.struct(inner["state"].alias("state"), F.concat(acc["out"], F.array(inner["out"])).alias("out")))

    def whole(every: Column) -> Column:
        chunks = F.transform(places(F.size(every)), lambda c: F.slice(every, c * FOLDED + 1, FOLDED))
        return F.aggregate(chunks, F.struct(state.alias("state"), F.array().cast(f"array<array<{out}>>").alias("out")), chunk, lambda acc: F.flatten(acc["out"]))

    # an expression inside a lambda is evaluated for each element, so `items` becomes a variable first
    return F.get(F.transform(F.array(items), whole), F.lit(0))


def _spans(text: Column, kind: str) -> Column:
    """All matches of a kind: array of (start, end, value, before), in code points.

    Splitting by the pattern gives what lies between the matches; the running
    lengths of both give the positions, and what they end with the context.
    """
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ahead = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if kind == "iban" else F.transform(found, lambda value: F.lit(""))

    def step(state: Column, pair: Column) -> tuple[Column, Column]:
        start = state["at"] + F.length(pair["gap"]).cast("bigint")
        end = start + F.length(pair["value"]).cast("bigint")
        before = F.right(F.concat(state["tail"], F.right(pair["gap"], F.lit(CONTEXT_CHARS))), F.lit(CONTEXT_CHARS))
        value = F.concat(pair["value"], pair["ahead"])
        after = F.right(F.concat(before, F.right(pair["value"], F.lit(CONTEXT_CHARS))), F.lit(CONTEXT_CHARS))
        match = F.struct(start.alias("start"), end.alias("end"), value.alias("value"), before.alias("before"))
        return F.struct(end.alias("at"), after.alias("tail")), F.array(match)

    # one gap more than there are matches
    pairs = F.filter(F.arrays_zip(found.alias("value"), F.split(text, pattern, -1).alias("gap"), ahead.alias("ahead")), lambda pair: pair["value"].isNotNull())
    spans = _fold(pairs, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("tail")), step, MATCH)
    return F.when(_may(text, kind), spans).otherwise(F.array().cast(f"array<{MATCH}>"))


def _may(text: Column, kind: str) -> Column:
    if NEEDS[kind]:
        return F.contains(text, F.lit(NEEDS[kind]))
    return text.rlike(PATTERNS[kind])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum is a multiple of ten: from the right, every second digit doubles."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(acc: Column, i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        doubled = digit * 2
        return acc + F.when(i % 2 == 1, digit).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _mod97(value: Column) -> Column:
    """The IBAN rule: first four characters to the end, letters as 10..35, remainder 1."""
    packed = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(packed, 5, 100), F.substring(packed, 1, 4))

    def add(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        number = F.when(code >= 65, code - 55).otherwise(code - 48)
        return (acc * F.when(number > 9, 100).otherwise(10) + number) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _registered(value: Column) -> Column:
    """Characters of an IBAN of the country that `value` begins with, null for countries without a registered length."""
    lengths = F.create_map(*[F.lit(x) for n, countries in IBAN_CHARS.items() for c in countries.split() for x in (c, n)])
    return F.try_element_at(lengths, F.substring(value, 1, 2))


def _ibans(spans: Column) -> Column:
    """From each head on, the IBAN of its country's length, or else the longest that ends with a group; in text order, without overlaps."""
    def ends(s: Column) -> Column:
        value = s["value"]

        def ends_at(e: Column) -> Column:
            whole = F.substring(value, F.lit(1), e)
            edge = F.substring(value, e, F.lit(2)).rlike("^[A-Z0-9](?![A-Za-z0-9])")
            chars = F.length(F.regexp_replace(whole, " ", ""))
            fits = F.coalesce(chars == _registered(value), chars.between(15, 34))
            return edge & F.when(edge & fits, _mod97(whole)).otherwise(F.lit(False))

        return F.array_max(F.filter(F.sequence(F.lit(15), F.length(value)), ends_at))

    def resolve(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), (s["start"] + ends(s)).alias("end"), s["value"].alias("value"), s["before"].alias("before"))

    def apart(end: Column, s: Column) -> tuple[Column, Column]:
        free = end <= s["start"]
        return F.when(free, s["end"]).otherwise(end), F.when(free, F.array(s)).otherwise(F.array().cast(f"array<{MATCH}>"))

    return _fold(F.filter(F.transform(spans, resolve), lambda s: s["end"].isNotNull()), F.lit(0).cast("bigint"), apart, MATCH)


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$")
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _scored(text: Column, kind: str) -> Column:
    """Confirmed spans of a kind, with their score."""
    kept = _ibans(_spans(text, kind)) if kind == "iban" else F.filter(_spans(text, kind), lambda s: _holds(kind, s["value"]))

    def score(s: Column) -> Column:
        before = s["before"]
        value = F.lit(BASE_SCORE[kind]) if kind != "iban" else F.when(_registered(s["value"]).isNull(), F.lit(UNREGISTERED_SCORE)).otherwise(F.lit(BASE_SCORE[kind]))
        value += F.when(before.rlike(CONTEXT[kind]), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        if kind in AGAINST:
            value -= F.when(before.rlike(AGAINST[kind]), F.lit(CONTEXT_MALUS)).otherwise(F.lit(0.0))
        bounded = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.round(bounded, 3).alias("score"))

    return F.transform(kept, score).cast(f"array<{SPAN}>")


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and one array of scored spans per kind.

    Spans count code points, the end is exclusive, and a kind's spans are in
    text order and don't overlap.  A null or empty text has no spans.
    """
    docs = common.documents(df, id_col, text_col)
    found = docs.select("doc_id", *[_scored(F.col("text"), k).alias(k) for k in (*BASE_KINDS, *ADDED_KINDS)])
    return found.select("doc_id", *BASE_KINDS, *[F.filter(k, lambda s: s["score"] >= LEAST_SCORE).alias(k) for k in ADDED_KINDS])


def _joined(kinds: tuple[str, ...]) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.flatten(F.array(*[F.transform(k, one) for k in kinds])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as one string."""
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_joined(BASE_KINDS), 256).alias("base_sha256"),
        _joined((*BASE_KINDS, *ADDED_KINDS)).alias("spans"),
        F.round(F.coalesce(F.array_max(F.transform(F.flatten(F.array(*BASE_KINDS, *ADDED_KINDS)), lambda s: s["score"])), F.lit(0.0)), 3).alias("top_score"),
    )


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with every reported span replaced by its kind in brackets, e.g. ``[EMAIL]``.

    Where spans of several kinds overlap, the one that starts first is
    replaced, of equal starts the longer one.  Null texts stay null, and texts
    without spans stay as they are.  Repeated rows are each treated; an empty table
    gives no rows; other columns pass through under whatever name.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    reported = [_scored(text, k) for k in BASE_KINDS] + [F.filter(_scored(text, k), lambda s: s["score"] >= LEAST_SCORE) for k in ADDED_KINDS]
    every = F.flatten(F.array(*reported))
    spans, whole = common.unused(df, "spans", "clean")
    found = df.withColumn(spans, F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind")))))
    # one more span of no length at the end brings what follows the last one
    last = F.struct(F.length(text).cast("bigint").alias("start"), (-F.length(text)).cast("bigint").alias("minus_end"), F.lit("").alias("kind"))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        gap = F.substring(text, (at + 1).cast("int"), (s["start"] - at).cast("int"))
        label = F.when(s["kind"] == "", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        free = s["start"] >= at
        return F.when(free, -s["minus_end"]).otherwise(at), F.when(free, F.array(gap, label)).otherwise(F.array().cast("array<string>"))

    clean = F.when(F.size(spans) == 0, F.col(text_col)).otherwise(F.array_join(_fold(F.concat(spans, F.array(last)), F.lit(0).cast("bigint"), step, "string"), ""))
    return found.withColumn(whole, clean).select(*[F.col(whole).alias(c) if c == text_col else F.col(c) for c in df.columns])
