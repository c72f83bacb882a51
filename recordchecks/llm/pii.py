"""Personal data by candidate gradient boosting (operator 4), on the JVM only.

Generators propose spans with high recall, and they overlap: the four base
patterns and five others (an e-mail with its signs written out, any run of
seven or more digits with separators, the usual format of a phone and of a card
number inside a longer run, a colon-separated address).  A
candidate has format features (digits, separators, dots, sign, check digit) and
context features (cue words to the left, characters on both sides), each cut
into a few bins.  The bins make a code with ``CODES`` values at most, so the
histogram of codes over every candidate of every text is exact and bounded; the
boosted trees are fitted on it and become one SQL expression.

There are no span labels, so the trees learn from the checks: a candidate equal
to a base span that passed is positive, one that overlaps without being equal is
not learnt from.  Of those that overlap none, the positives are what the added
generators' own rules of format and context hold for (``rule``: a spelled-out
sign or a cue for an e-mail, a phone cue and ten digits or an area code in
brackets, a separated number behind a plus, a check digit, the groups of an IPv6
address); the rest is negative.  Trees of all generators come first; each added
generator then has some of its own on top, so one with few candidates is learnt
too.  On a third of the texts, kept from the fit, a threshold is calibrated for
each generator: the lowest score seen from which on every score's precision is
``MIN_PRECISION`` (none, and so nothing added, where that third holds no candidate
of it or only bad ones).  Base spans always stay; the method
adds candidates above their threshold that overlap no base span.

Every step on the texts is DataFrame or SQL functions.  Patterns use possessive
quantifiers, so a long run costs linear time and no stack.

Defined results: null text counts as empty; repeated rows are scored one by
one; a text without candidates has zero counts and empty spans; other input
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordchecks.functions.arrays import CHUNK, bind, running
from recordchecks.llm.common import read_table, store

KINDS = ("email", "ip", "card", "phone")
LOCAL = r"[A-Za-z0-9._%+-]"
# The look-behinds only skip starts inside a run whose first start has failed.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {  # name: (kind, pattern); these also find a span that a base match runs past
    "loose email": ("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)++"),
    "digit run": ("phone", r"\+?\(?[0-9](?:[\x20().\-/]{0,2}[0-9])++"),
    "phone format": ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])"),
    "card format": ("card", r"(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])"),
    "loose ip": ("ip", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}+(?![0-9A-Za-z:])"),
}
# A text without a match of its guard has no match of the pattern.
GUARD = {"email": "@", "loose email": r"@|[(\[]at[)\]]", "loose ip": ":", "phone": r"\+", "phone format": r"\+"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
QUAD = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
HEX = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"^(?:{HEX}(?::{HEX}){{7}}|(?!.*::.*::)(?!.*:::){HEX}(?::{HEX})*::(?:{HEX}(?::{HEX})*)?)$"
IPV6_KNOWN = rf"^(?:{HEX}(?::{HEX}){{7}}|(?:[23][0-9a-f]{{3}}|fe[89ab][0-9a-f]|f[cd][0-9a-f]{{2}}):.*)$"
CUES = ("mail|contact|write", "phone|call|tel|mobile|fax", "card|visa|account|payment", r"\bip\b|address|host|server",
        "key|token|secret|password|sha|hash|id")
CONTEXT = 24
# bins of each feature, in the order of the code's digits
BINS = {"generator": 9, "digits": 7, "marks": 4, "plus": 2, "at": 3, "dots": 5, "cue": 6, "left": 4, "right": 4, "check": 3}
CODES = int(np.prod(list(BINS.values())))
FOUND = "array<struct<start:bigint,end:bigint,generator:int,kind:string,base:boolean,code:bigint,touches:boolean,equals:boolean>>"
ROUNDS, OWN_ROUNDS, DEPTH, RATE, MIN_PRECISION = 20, 10, 3, 0.3, 0.9


def zero() -> Column:
    return F.lit(0).cast("long")


def luhn(digits: Column) -> Column:
    def term(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def only_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def matches(text: Column, pattern: str, guard: str, generator: int, kind: str) -> Column:
    """Array of candidate structs of one generator."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))

    def build(m: Column, gaps: Column) -> Column:
        # gap 0, match 0, gap 1, match 1, ..., rest
        sizes = F.flatten(F.zip_with(gaps, m, lambda g, x: F.array(F.length(g).cast("long"), F.coalesce(F.length(x), F.lit(0)).cast("long"))))
        return bind(running(sizes, zero(), lambda x, y: x + y), lambda at: F.transform(m, lambda x, i: F.struct(
            F.lit(generator).alias("generator"), F.lit(kind).alias("kind"), F.get(at, 2 * i + 1).alias("start"),
            (F.get(at, 2 * i + 1) + F.length(x)).alias("end"), x.alias("m"), F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("l"),
            F.left(F.get(gaps, i + 1), F.lit(1)).alias("r"))))

    none = F.expr("cast(array() as array<struct<generator:int,kind:string,start:bigint,end:bigint,m:string,l:string,r:string>>)")
    some = bind(found, lambda m: F.when(F.size(m) > 0, bind(F.split(text, pattern, -1), lambda gaps: build(m, gaps))).otherwise(none))
    return F.when(F.regexp_like(text, F.lit(guard)), some).otherwise(none)


def passes(c: Column) -> Column:
    """The base checks of a candidate of a base generator."""
    n = F.length(only_digits(c["m"]))
    return (F.when(c["kind"] == "email", True)
            .when(c["kind"] == "ip", F.regexp_like(c["m"], F.lit(QUAD)))
            .when(c["kind"] == "card", F.when((n >= 12) & (n <= 19), luhn(only_digits(c["m"]))).otherwise(False))
            .otherwise((n >= 9) & (n <= 15)))


def binned(n: Column, *edges: int) -> Column:
    """Number of edges that ``n`` reaches."""
    return sum((n >= e).cast("int") for e in edges)


def char_class(c: Column) -> Column:
    return (F.when(F.coalesce(c, F.lit("")) == "", 0).when(F.regexp_like(c, F.lit(r"^\s")), 1)
            .when(F.regexp_like(c, F.lit(r"^[\p{L}\p{N}]")), 2).otherwise(3))


def rule(c: Column) -> Column:
    """Whether the format and the context of an added generator's candidate speak for it, also where no base span can."""
    def has(text: Column, pattern: str) -> Column:
        return F.regexp_like(text, F.lit(pattern))

    m, left, n = c["m"], F.lower(c["l"]), F.length(only_digits(c["m"]))
    mail, call, host = (has(left, rf"\b(?:{words})\b") for words in (
        "e-?mail|mail|contact|write", "phone|telephone|call|tel|mobile|cell|fax", "ip|ipv6|address|host|server"))
    holds = {
        "loose email": has(m, r"(?:\.|(?:\(dot\)|\[dot\])\x20?)[A-Za-z]{2,}$") & (has(m, r"[(\[](?:at|dot)[)\]]") | (has(m, r"\x20") & mail)),
        "digit run": has(m, r"^\([0-9]{3}\)\x20?[0-9]{3}[\x20.-]?[0-9]{4}$") | (((n == 10) | ((n == 11) & has(m, r"^\+?1"))) & call),
        "phone format": has(m, r"[\x20.()-]") | call,
        "card format": luhn(only_digits(m)),
        "loose ip": has(m, IPV6) & has(m, "[0-9]") & (has(F.lower(m), IPV6_KNOWN) | host),
    }
    out = F.lit(False)
    for i, name in enumerate(LOOSE, len(BASE)):
        out = F.when(c["generator"] == i, holds[name]).otherwise(out)
    return out


def features(c: Column) -> dict[str, Column]:
    digits, n = only_digits(c["m"]), F.length(only_digits(c["m"]))
    cue = F.lit(0)
    for k, words in reversed(list(enumerate(CUES, 1))):
        cue = F.when(F.regexp_like(F.lower(c["l"]), F.lit(words)), k).otherwise(cue)
    return {
        "generator": c["generator"], "digits": binned(n, 1, 7, 9, 12, 16, 20),
        "marks": binned(F.length(F.regexp_replace(c["m"], r"[^ ()\-/:]", "")), 1, 3, 5),
        "plus": F.startswith(c["m"], F.lit("+")).cast("int"),
        "at": F.when(F.contains(c["m"], F.lit("@")), 1).when(F.regexp_like(c["m"], F.lit(r"[(\[]at[)\]]")), 2).otherwise(0),
        "dots": binned(F.length(F.regexp_replace(c["m"], r"[^.]", "")), 1, 2, 3, 4),
        "cue": cue, "left": char_class(F.right(c["l"], F.lit(1))), "right": char_class(c["r"]),
        "check": F.when(rule(c), 2).otherwise(F.when(F.regexp_like(c["m"], F.lit(QUAD)), True).when((n >= 12) & (n <= 19), luhn(digits)).otherwise(False).cast("int")),
    }


def code_of(c: Column) -> Column:
    code = F.lit(0).cast("long")
    for name, value in features(c).items():
        code = code * BINS[name] + value
    return code


def candidates(text: Column) -> Column:
    """Array of every candidate of a text by start, end and generator: ``start,
    end, generator, kind, base, code`` and, of the base spans, whether it
    touches (overlaps) one and equals one of its kind."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    parts = [matches(text, p, GUARD.get(k, "[0-9]"), i, k) for i, (k, p) in enumerate(BASE.items())]
    parts += [matches(text, p, GUARD.get(name, "[0-9]"), i, k) for i, (name, (k, p)) in enumerate(LOOSE.items(), len(BASE))]
    digit_run = len(BASE) + list(LOOSE).index("digit run")
    found = F.filter(F.concat(*parts), lambda c: (c["generator"] != digit_run) | (F.length(only_digits(c["m"])) >= 7))
    found = F.array_sort(F.transform(found, lambda c: F.struct(
        c["start"], c["end"], c["generator"], c["kind"],
        ((c["generator"] < len(BASE)) & passes(c)).alias("base"), code_of(c).alias("code"))))
    return bind(found, lambda all_: F.when(F.size(all_) > 0, beside_base(all_)).otherwise(
        F.expr(f"cast(array() as {FOUND})")))


def beside_base(found: Column) -> Column:
    """Adds ``touches`` and ``equals`` to sorted candidates, by running folds in both directions."""
    far = F.lit(2 ** 62).cast("long")
    before = running(F.transform(found, lambda c: F.when(c["base"], c["end"]).otherwise(zero())), zero(), F.greatest)
    after = F.reverse(running(F.transform(F.reverse(found), lambda c: F.when(c["base"], c["start"]).otherwise(far)), far, F.least))
    # in this order a base span equal to a candidate is the last base span before it
    last = running(F.transform(found, lambda c: F.when(c["base"], F.struct(c["start"].alias("s"), c["end"].alias("e"), c["kind"].alias("k")))),
                   F.expr("cast(null as struct<s:bigint,e:bigint,k:string>)"), lambda a, b: F.coalesce(b, a))
    return F.transform(F.arrays_zip(found.alias("c"), before.alias("b"), after.alias("a"), last.alias("l")), lambda z: F.struct(
        *(z["c"][n].alias(n) for n in ("start", "end", "generator", "kind", "base", "code")),
        ((z["b"] > z["c"]["start"]) | (z["a"] < z["c"]["end"])).alias("touches"),
        F.coalesce((z["l"]["s"] == z["c"]["start"]) & (z["l"]["e"] == z["c"]["end"]) & (z["l"]["k"] == z["c"]["kind"]), F.lit(False)).alias("equals")))


def unpack(codes: np.ndarray) -> np.ndarray:
    """(n, features) bins of codes."""
    out = []
    for size in reversed(list(BINS.values())):
        out.append(codes % size)
        codes = codes // size
    return np.stack(out[::-1], axis=1)


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on weighted gradients: (feature, bin, low, high) or a leaf value."""
    best = None
    if depth:
        score = g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            gs, hs = np.bincount(x[:, f], g), np.bincount(x[:, f], h)
            gl, hl = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
            gain = gl ** 2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - score
            if len(gain) and gain.max() > 1e-6 and (best is None or gain.max() > best[0]):
                best = gain.max(), f, int(np.argmax(gain))
    if best is None:
        return float(-RATE * g.sum() / (h.sum() + 1))
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], g[low], h[low], depth - 1), grow(x[~low], g[~low], h[~low], depth - 1)


def predict(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], predict(tree[2], x), predict(tree[3], x))


def boost(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, score: np.ndarray, rounds: int) -> list:
    """Trees of logistic boosting on counts, on top of the log-odds ``score``."""
    total, trees = positive + negative, []
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(x, total * p - positive, total * p * (1 - p), DEPTH))
        score = score + predict(trees[-1], x)
    return trees


def fit(found: DataFrame) -> tuple[float, list, dict[int, list], dict[int, float]]:
    """Start, trees, and by generator its own trees and threshold, from a table of ``found`` and ``kept``."""
    each = found.where(F.size("found") > 0).select("kept", F.explode("found").alias("c"))
    ruled = F.pmod(F.col("c.code"), F.lit(BINS["check"])) == 2  # the last digit of the code
    label = F.when(F.col("c.base") | F.col("c.equals"), 1).when(~F.col("c.touches"), ruled.cast("int"))
    hist = each.select("kept", F.col("c.code").alias("code"), label.alias("y")).where("y is not null")
    rows = hist.groupBy("kept", "code").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).collect()  # 2 x CODES rows at most
    rows = sorted((r["code"], r["kept"], r["pos"], r["neg"]) for r in rows)
    code, kept, pos, neg = (np.array([r[k] for r in rows], t) for k, t in enumerate((np.int64, bool, np.float64, np.float64)))
    x = unpack(code).reshape(-1, len(BINS))
    start = float(np.log((pos[~kept].sum() + 1) / (neg[~kept].sum() + 1)))
    trees = boost(x[~kept], pos[~kept], neg[~kept], np.full(int((~kept).sum()), start), ROUNDS)
    score = start + sum((predict(t, x) for t in trees), np.zeros(len(x)))
    own, thresholds = {}, {}
    for g in range(BINS["generator"]):
        mine = ~kept & (x[:, 0] == g)
        own[g] = boost(x[mine], pos[mine], neg[mine], score[mine], OWN_ROUNDS) if g >= len(BASE) else []
        mine = kept & (x[:, 0] == g)
        s, p, n = score[mine] + sum((predict(t, x[mine]) for t in own[g]), np.zeros(int(mine.sum()))), pos[mine], neg[mine]
        levels, at = np.unique(s, return_inverse=True)
        share = np.bincount(at, p) / np.bincount(at, p + n) if len(levels) else levels
        bad = np.flatnonzero(share < MIN_PRECISION)
        lowest = bad[-1] + 1 if len(bad) else 0
        if lowest < len(levels):
            thresholds[g] = float(levels[lowest])
    return start, trees, own, thresholds


def tree_column(tree, bins: list[Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    return F.when(bins[tree[0]] <= tree[1], tree_column(tree[2], bins)).otherwise(tree_column(tree[3], bins))


def score(code: Column, generator: Column, start: float, trees: list, own: dict[int, list]) -> Column:
    """Log-odds of a candidate's code; ``own``: trees by generator."""
    bins, divisor = [], CODES
    for size in BINS.values():
        divisor //= size
        bins.append(F.floor(code / divisor) % size)
    total, more = F.lit(start), F.lit(0.0)
    for tree in trees:
        total = total + tree_column(tree, bins)
    for g, some in own.items():
        more = F.when(generator == g, sum((tree_column(t, bins) for t in some), F.lit(0.0))).otherwise(more)
    return total + more


def chosen(found: Column, model: tuple[float, list, dict[int, list], dict[int, float]]) -> Column:
    """Array of ``start, kind_no, end, kind, base`` of all spans: the base spans
    and, above its threshold, the leftmost candidate of a run of overlapping
    ones that touches no base span; sorted by start, then kind."""
    start, trees, own, thresholds = model

    def good(c: Column) -> Column:
        least = F.lit(None).cast("double")
        for g, t in thresholds.items():
            least = F.when(c["generator"] == g, t - 1e-9).otherwise(least)  # the sums' order differs from the fit's
        mine = {g: own[g] for g in thresholds if own[g]}
        return ~c["base"] & ~c["touches"] & F.coalesce(score(c["code"], c["generator"], start, trees, mine) >= least, F.lit(False))

    def apart(extra: Column) -> Column:
        reach = running(F.transform(extra, lambda c: c["end"]), zero(), F.greatest)
        kept = F.filter(F.zip_with(extra, reach, lambda c, r: F.when(r <= c["start"], c)), lambda c: c.isNotNull())
        return F.concat(F.filter(found, lambda c: c["base"]), kept)

    return F.array_sort(F.transform(bind(F.filter(found, good), apart), lambda c: F.struct(
        c["start"], F.array_position(F.array(*map(F.lit, KINDS)), c["kind"]).alias("kind_no"), c["end"], c["kind"], c["base"])))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def candidate_table(docs: DataFrame, text_col: str, *columns: Column) -> DataFrame:
    """``columns``, the candidates of each text as ``found``, and ``kept``: kept from the fit, a third by hash."""
    kept = F.pmod(F.xxhash64(F.col(text_col).cast("string")), F.lit(3)) == 0
    return store(docs.select(*columns, candidates(F.col(text_col)).alias("found"), kept.alias("kept")), "pii-candidates")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256, spans, n_added`` per row."""
    found = candidate_table(docs, text_col, F.col(id_col).alias("id"))
    model = fit(found)
    rows = found.select("id", chosen(F.col("found"), model).alias("spans"))
    base = F.filter("spans", lambda c: c["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda c: c["base"] & (c["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return rows.select(F.col("id").alias(id_col), *map(count, KINDS), F.sha2(span_text(base), 256).alias("base_sha256"),
                       span_text(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda c: ~c["base"])).cast("long").alias("n_added"))


def without(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by ``[KIND]``; spans that overlap become
    one mark, named by the first."""
    def cut(reach: Column) -> Column:
        # text from a to b and a mark for each span; one inside an earlier one leaves nothing
        steps = F.zip_with(spans, reach, lambda c, r: F.struct(
            r.alias("a"), F.greatest(r, c["start"]).alias("b"), F.greatest(r, c["end"]).alias("reach"),
            F.when(c["start"] >= r, F.concat(F.lit("["), F.upper(c["kind"]), F.lit("]"))).otherwise("").alias("mark")))
        return bind(steps, lambda s: F.concat(F.array_join(pieces(s), ""), part(text, F.get(s, F.size(s) - 1)["reach"], F.length(text).cast("long"))))

    def pieces(steps: Column) -> Column:
        # a chunk of spans looks at its own stretch of the text
        def chunk(k: Column) -> Column:
            return bind(F.slice(steps, k * CHUNK + 1, CHUNK), lambda some: bind(
                part(text, F.get(some, F.lit(0))["a"], F.get(some, F.size(some) - 1)["b"]),
                lambda near: F.transform(some, lambda c: F.concat(
                    part(near, c["a"] - F.get(some, F.lit(0))["a"], c["b"] - F.get(some, F.lit(0))["a"]), c["mark"]))))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), chunk))

    return F.when(F.size(spans) > 0, bind(running(F.transform(spans, lambda c: c["end"]), zero(), F.greatest), cut)).otherwise(text)


def part(text: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` (from 0) to ``end``, exclusive."""
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``[KIND]``.  Null text stays null."""
    model = fit(candidate_table(docs, text_col))
    spans = "spans"
    while spans in docs.columns:
        spans += "_"
    # in steps, as the analyzer resolves a nesting of lambdas one level a round
    rows = docs.withColumn(spans, candidates(F.col(text_col))).withColumn(spans, chosen(F.col(spans), model))
    return rows.withColumn(text_col, without(F.col(text_col).cast("string"), F.col(spans))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read_table(spark, sf_dir, "documents"))
