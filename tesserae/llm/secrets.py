"""Secret scan: key formats by regular expression, and sliding-window Shannon entropy over candidate strings.

All of it is native SQL, in time linear in the text. Extracting ``\\G.*?pattern``
gives each match with the text since the one before, so running sums of lengths
are places. Spark copies the state of a fold at every step, so no fold holds a
list but `_running`, in blocks; what is read again in a fold is bound by `_let`.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits per character that a window must reach, by character class; no window of 20 characters has exactly these.
HEX_BITS, ALNUM_BITS, MIXED_BITS = 2.9, 3.7, 3.85
#: Candidates that are never secrets: words, plain numbers, UUIDs, dates and paths of words, whole sample keys.
ALLOWED = (
    "^[A-Za-z/_=-]+$|^[0-9+/_=-]+$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^[A-Za-z0-9]{1,12}([/_-][A-Za-z0-9]{1,12})+$"
    "|^AKIA[A-Z0-9]{0,12}EXAMPLE$|^[A-Za-z0-9/+]{30}EXAMPLEKEY$"
)

#: The same for Java's matcher, which recurses at each round of a group unless it is possessive; a round ends where its separator does, so none would be given back.
_ALLOWED = ALLOWED.replace(")+$", ")++$")

#: Counts of a window are fields of 5 bits, 12 in a long; a character's field is its code less that of "+", the least one.
_FIELDS, _WORDS, _LEAST = 12, 7, ord("+")
#: c log2 c in units of 2 ** -40: sums of integers do not drift, however long a candidate is.
_UNIT = 1 << 40
_CLOG = [0] + [round(c * log2(c) * _UNIT) for c in range(1, WINDOW + 1)]
#: Running values are folded in blocks of this many.
_BLOCK = 64
#: Texts are cut into stretches of this many characters, so that a part is taken without a walk from the text's start.
_CUT = 1024
_SPANS = "array<struct<start:int,kind:int,end:int,body:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often and in whatever fold body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op of each value (int) and all before it: in blocks, then over the blocks."""
    last = lambda x: F.element_at(x, -1)
    fold = lambda of: F.aggregate(F.slice(of, 2, F.size(of)), F.slice(of, 1, 1), lambda acc, x: F.concat(acc, F.array(op(last(acc), x))))

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: _let(F.slice(v, b * _BLOCK + 1, _BLOCK), fold))

    def whole(local: Column) -> Column:
        before = _let(F.transform(local, last), fold)
        return _let(before, lambda m: F.flatten(F.transform(local, lambda x, j: F.when(j == 0, x).otherwise(F.transform(x, lambda y: op(F.get(m, j - 1), y))))))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(blocks(v), whole)).otherwise(v))


def _spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Array of (start, kind, end, text of the group), leftmost and not overlapping."""
    pieces = F.regexp_extract_all(text, F.lit(f"\\G(?s:.*?)(?:{pattern})"), F.lit(0))

    def span(e: Column, end: Column) -> Column:
        size = F.char_length(F.regexp_extract(e, pattern, 0))
        return F.struct((end - size).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.regexp_extract(e, pattern, group).alias("body"))

    def found(p: Column) -> Column:
        return _let(_running(F.transform(p, F.char_length), lambda x, y: x + y), lambda ends: F.transform(p, lambda e, k: span(e, F.get(ends, k))))

    return F.when(text.rlike(pattern), _let(pieces, found)).otherwise(F.array().cast(_SPANS))


def _replaced(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """The text without the stretches that sorted spans cover; each span adds by(span, end of the spans before it) in its place."""

    def whole(cuts: Column, end: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first = (a / _CUT).cast("int")
            near = F.array_join(F.slice(cuts, first + 1, F.greatest((b / _CUT).cast("int") - first + 1, F.lit(0))), "")
            return F.substr(near, a - first * _CUT + 1, b - a)

        def part(x: Column, k: Column) -> Column:
            covered = F.when(k == 0, F.lit(0)).otherwise(F.get(end, k - 1))
            return _let(covered, lambda c: F.concat(F.when(x["start"] > c, between(c, x["start"])).otherwise(F.lit("")), by(x, c)))

        rest = _let(F.element_at(end, -1), lambda c: between(c, F.char_length(text)))
        return F.array_join(F.concat(F.transform(spans, part), F.array(rest)), "")

    ends = _running(F.transform(spans, lambda x: x["end"]), F.greatest)
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CUT}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(cut, lambda c: _let(ends, lambda e: whole(c, e)))).otherwise(text)


def _windows(body: Column, bits: Column) -> Column:
    """(first, last): offsets of the first and last window of WINDOW characters that reaches `bits`; first is -1 if none does.

    The entropy of a window is log2(W) - sum(c log2 c) / W. One character comes
    in and one goes out at a step, so two counts change and the sum is updated
    by their terms only.
    """
    clog = F.lit(_CLOG)
    most = F.floor((F.lit(log2(WINDOW)) - bits) * WINDOW * _UNIT)
    place = lambda code: ((code / _FIELDS).cast("int"), (code % _FIELDS) * 5)
    one = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), by)
    count = lambda counts, at: F.call_function("shiftright", F.get(counts, at[0]), at[1]).bitwiseAND(31).cast("int")
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), _WORDS).alias("counts"), F.lit(0).cast("long").alias("s"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def fold(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            into, out, leaves = place(F.get(codes, i)), place(F.get(codes, i - WINDOW)), i >= WINDOW
            same = leaves & (F.get(codes, i) == F.get(codes, i - WINDOW))
            a, b = count(acc["counts"], into), count(acc["counts"], out)
            s = F.when(same, acc["s"]).otherwise(
                acc["s"] + F.get(clog, a + 1) - F.get(clog, a) + F.when(leaves, F.get(clog, b - 1) - F.get(clog, b)).otherwise(F.lit(0).cast("long"))
            )
            moved = F.transform(
                acc["counts"],
                lambda c, j: c + F.when(j == into[0], one(into[1])).otherwise(F.lit(0).cast("long")) - F.when(leaves & (j == out[0]), one(out[1])).otherwise(F.lit(0).cast("long")),
            )
            s_let = lambda s: F.struct(
                F.when(same, acc["counts"]).otherwise(moved).alias("counts"), s.alias("s"),
                F.when((i >= WINDOW - 1) & (s <= most) & (acc["first"] < 0), i - (WINDOW - 1)).otherwise(acc["first"]).alias("first"),
                F.when((i >= WINDOW - 1) & (s <= most), i - (WINDOW - 1)).otherwise(acc["last"]).alias("last"),
            )
            return _let(s, s_let)

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return _let(F.transform(F.split(body, "(?!^)(?!$)"), lambda c: F.ascii(c) - _LEAST), fold)


def _entropy_spans(text: Column, base: Column) -> Column:
    blanked = _replaced(text, base, lambda x, c: F.repeat(F.lit(" "), F.greatest(x["end"] - F.greatest(x["start"], c), F.lit(0))))
    candidates = F.filter(_let(blanked, lambda t: _spans(t, CANDIDATE, 3)), lambda c: ~c["body"].rlike(_ALLOWED))
    bits = lambda body: F.when(body.rlike("^[0-9a-fA-F]+$"), HEX_BITS).when(body.rlike("^[0-9a-zA-Z]+$"), ALNUM_BITS).otherwise(F.lit(MIXED_BITS))
    windows = lambda c: _let(bits(c["body"]), lambda b: _windows(c["body"], b))
    tried = F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), windows(c).alias("w")))
    kept = F.filter(tried, lambda x: x["w"]["first"] >= 0)
    return F.transform(kept, lambda x: F.struct((x["start"] + x["w"]["first"]).alias("start"), F.lit(3).alias("kind"), (x["start"] + x["w"]["last"] + WINDOW).alias("end")))


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the array column secret_spans of (start, kind, end), sorted, to every row.

    kind is an index into KINDS; starts and ends are code points, ends
    exclusive. Null and empty texts have no spans. Candidates of the entropy
    scan are runs of 20 or more of [A-Za-z0-9+/_=-] outside base spans: what is
    joined to a base span is scanned on its own. An entropy span is one
    candidate's stretch from its first to its last window over the threshold;
    candidates on the allow-list have none.
    Repeated rows are scanned each on its own; an input column secret_spans is replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    keep = F.filter(_spans(t, ASSIGN, 0, 1), lambda x: F.char_length(x["body"]) >= 8)
    base = F.transform(F.concat(keep, _spans(t, ACCESS, 1), _spans(t, HEX, 2)), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    own = [c for c in docs.columns if c != "secret_spans"]
    more = lambda b: F.when(t.rlike(CANDIDATE), F.concat(b, _entropy_spans(t, b))).otherwise(b)
    return docs.select(*own, _let(F.sort_array(base), lambda b: F.sort_array(more(b))).alias("secret_spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same columns with every secret's characters replaced by the mark; overlapping spans become one mark.

    Rows without a secret, null texts included, stay as they are.
    """
    found = scan_secrets(docs, text)
    clean = _replaced(F.col(text), F.col("secret_spans"), lambda x, c: F.when(x["start"] >= c, F.lit(mark)).otherwise(F.lit("")))
    return found.withColumn(text, clean).select(docs.columns)


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts by base kind, the hash of the base spans and all spans as text."""
    found = scan_secrets(docs.select(doc_id, text), text)
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("secret_spans", lambda x: x["kind"] < 3)
    return found.select(
        F.col(doc_id).alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("secret_spans")).alias("spans"),
    )
