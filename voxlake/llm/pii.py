"""Personal data in texts, found by DataFrame functions only.

Regular expressions propose spans, checksum validators (Luhn, mod-97, the IPv4
range) confirm them, and context words nearby adjust a score.  Four base kinds
are always reported; further kinds are reported where their score reaches a
threshold.

The expressions below match exactly what their plain forms match, in time
linear in the text and without recursion: separators that join two digits (or
dots that join two labels) are first replaced, one for one, by a mark that
texts cannot hold after step one, so that each run is one character class.
Positions are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MARK, SPARE = "\ue000", "\ue001"
BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "ssn", "secret")
KINDS = (*BASE_KINDS, *EXTRA_KINDS)

_LOCAL = rf"[A-Za-z0-9._%+{MARK}-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"(?<![0-9{MARK}])[0-9](?:{MARK}?[0-9]){{13,18}}(?![0-9{MARK}])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
#: Keys and passwords: a long run of characters that must look random; only words nearby make it a secret.
SECRET = r"[A-Za-z0-9_+/-]{20,}"
#: The same runs without those that have no digit, tried only where a run begins: no character is looked at once for each start within a word.
_SECRET_RUN = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{20,}+"
SECRET_DIGITS, SECRET_LETTERS, SECRET_DISTINCT = 5, 4, 10
#: Characters that must not stand next to a span of an added kind.
BORDER = {"iban": "[A-Za-z0-9]", "ssn": "[0-9-]", "secret": "[A-Za-z0-9_+/-]"}

#: Words near a span that raise or lower its score, and how far they are looked for.
RAISING = {
    "email": "mail|contact|write", "ip": "address|server|host|login", "card": "card|visa|credit|pay", "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|cuenta|compte", "ssn": "ssn|social|security|tax", "secret": "token|secret|passw|api.?key|access.?key|private.?key|bearer|credential",
}
LOWERING = {
    "email": "sample|example", "ip": "sample|example|version", "card": "sample|example|serial|part", "phone": "sample|example|serial|part",
    "iban": "sample|example|serial|part", "ssn": "sample|example|serial|part|order|invoice", "secret": "sample|example|checksum|digest|commit|md5|sha1|sha256",
}
START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.7, "ssn": 0.3, "secret": 0.3}
NEAR, STEP, LEAST_SCORE = 40, 0.3, 0.5


def _marked(text: Column, joined: str) -> Column:
    """The text with each separator that joins two characters of a run replaced by MARK."""
    return F.regexp_replace(F.translate(text, MARK, SPARE), joined, MARK)


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, end, kind, value>> of the leftmost non-overlapping matches.

    Each element of the extraction is what lies before a match and the match
    itself, so the elements' lengths add up to the ends of the matches.  Each
    begins where the last one ended, or the search over what follows the last
    match would begin anew at every character.
    """
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?(?:{pattern})"), F.lit(0))
    values = F.transform(parts, lambda p: F.struct(F.length(p).alias("length"), F.regexp_extract(p, pattern, 0).alias("value")))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")
    ends = F.aggregate(
        values,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, v: F.struct(
            (acc["at"] + v["length"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + v["length"] - F.length(v["value"])).alias("start"), (acc["at"] + v["length"]).alias("end"), F.lit(kind).alias("kind"), v["value"].alias("value")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return ends


def _digits(value: Column) -> Column:
    return F.transform(F.filter(F.split(value, ""), lambda c: c.rlike("^[0-9]$")), lambda c: c.cast("int"))


def luhn(value: Column) -> Column:
    """Whether the value's digits pass: from the right, every second one doubled, the digits' sum a multiple of 10."""
    digits = F.reverse(_digits(value))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters read as 10 to 35, leaves 1 when divided by 97."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    number = F.filter(F.transform(turned, lambda c: F.when(c == "", F.lit(None)).when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)), lambda d: d.isNotNull())
    return F.aggregate(number, F.lit(0), lambda a, d: (a * F.when(d > 9, 100).otherwise(10) + d) % 97) == 1


def looks_random(value: Column) -> Column:
    """Whether a run of characters has digits, letters and different characters enough for a key."""
    digits, letters = F.length(F.regexp_replace(value, "[^0-9]", "")), F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    return (digits >= SECRET_DIGITS) & (letters >= SECRET_LETTERS) & (F.size(F.array_distinct(F.split(value, ""))) >= SECRET_DISTINCT)


def _small_parts(value: Column) -> Column:
    """Whether all dotted parts are at most 255, however many digits they have."""
    return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")).between(1, 3) & (F.substring(F.regexp_replace(p, "^0+(?=[0-9])", ""), 1, 3).cast("int") <= 255))


def _stands_alone(text: Column, kind: str, span: Column) -> Column:
    """Whether the characters before and after the span aren't of the kind's own."""
    before = F.when(span["start"] > 0, F.substring(text, span["start"], F.lit(1))).otherwise(F.lit(""))
    return ~F.concat(before, F.substring(text, span["end"] + 1, F.lit(1))).rlike(BORDER[kind])


def _score(text: Column, kind: str, span: Column) -> Column:
    """The kind's own score, raised or lowered by words within NEAR characters of the span."""
    start = F.greatest(span["start"] - NEAR, F.lit(0))
    near = F.lower(F.concat(F.substring(text, start + 1, span["start"] - start), F.lit(" "), F.substring(text, span["end"] + 1, F.lit(NEAR))))
    return F.least(F.lit(1.0), F.lit(START_SCORE[kind]) + F.when(near.rlike(RAISING[kind]), STEP).otherwise(0.0) - F.when(near.rlike(LOWERING[kind]), STEP).otherwise(0.0))


def _if_any(text: Column, quick: str, spans: Column) -> Column:
    """The spans, worked out only for texts that hold a character they need."""
    return F.when(text.rlike(quick), spans).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>"))


def _scored(text: Column, order: int, kind: str) -> Column:
    """The kind's spans with their score, in a shape that sorts by start and then kind; of the added kinds those that reach LEAST_SCORE."""

    def row(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), _score(text, kind, s).alias("score"))

    rows = F.transform(F.col(f"__{kind}"), row)
    return rows if kind in BASE_KINDS else F.filter(rows, lambda s: s["score"] >= LEAST_SCORE)


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus spans: array<struct<start, end, kind, score>>, by start and then kind as in KINDS.

    Base kinds match the documented expressions leftmost and without overlap
    within a kind; matches that fail their check (parts up to 255; 14 to 19
    digits that pass Luhn; 10 to 15 digits) are dropped, not retried.  Words
    near a span raise or lower its score: base spans stay whatever it is, others
    where it reaches LEAST_SCORE.  Spans of two kinds may overlap.  ``start`` counts code points from 0, ``end`` is
    exclusive.  Null counts as empty and has no spans.  A column of the input
    named spans is replaced; an empty table gives an empty result.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "spans" and not c.startswith("__")]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    label = r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"
    number = r"(?<=[0-9])[\x20-](?=[0-9])"
    raw = {
        "email": _if_any(text, "@", _spans(_marked(text, label), EMAIL, "email")),
        "ip": _if_any(text, r"[0-9]\.[0-9]", F.filter(_spans(text, IP, "ip"), lambda s: _small_parts(s["value"]))),
        "card": _if_any(text, r"[0-9]{2}|[0-9][\x20-][0-9]", F.filter(_spans(_marked(text, number), CARD, "card"), lambda s: luhn(s["value"]))),
        "phone": _if_any(text, r"\+[0-9]", F.filter(_spans(text, PHONE, "phone"), lambda s: F.size(_digits(s["value"])).between(10, 15))),
        "iban": _if_any(text, "[A-Z]{2}[0-9]{2}", F.filter(_spans(text, IBAN, "iban"), lambda s: mod97(s["value"]) & _stands_alone(text, "iban", s))),
        "ssn": _if_any(text, "[0-9]-[0-9]{2}-[0-9]", F.filter(_spans(text, SSN, "ssn"), lambda s: _stands_alone(text, "ssn", s))),
        "secret": _if_any(text, _SECRET_RUN, F.filter(_spans(text, _SECRET_RUN, "secret"), lambda s: looks_random(s["value"]))),
    }
    scored = [_scored(text, order, kind) for order, kind in enumerate(KINDS)]
    found = docs.select(*kept, *[c.alias(f"__{kind}") for kind, c in raw.items()])
    ordered = F.array_sort(F.concat(*scored))
    return found.select(*kept, F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score"))).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``find_spans`` with each span's characters in the text replaced by its kind in brackets; overlapping spans go as one."""
    found = find_spans(docs, text_col)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    step = F.aggregate(
        F.col("spans"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), s["kind"], F.lit("]")))).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return found.withColumn(text_col, step)
