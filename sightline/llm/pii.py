"""Personal data by weak supervision (operator 13, DataFrame functions only).

Candidates are the base matches and looser ones: obfuscated e-mail addresses, addresses with eight hexadecimal
groups, card numbers that stand next to other digits, phone numbers without a plus sign. A
pattern's matches and the gaps between them come out of one text as two arrays; running sums of their
lengths are the positions. Five labelers vote yes, no or nothing on each candidate: the strict pattern, the
structure of the value, a gazetteer (top-level domains, card issuers, reserved networks, calling codes),
words before it, and the characters at its borders. All documents' votes are counted per kind and
pattern of votes (at most 4 x 3^5 rows), expectation-maximisation estimates from these counts how reliable
each labeler is, and the votes' posterior is the soft label with which a logistic regression over features
of the span (at most `FEATURE_ROWS` counted rows per kind) is fitted. A candidate outside the base spans
is added if that classifier gives it `THRESHOLD` or more. Base spans always stay.

The driver sees only those two tables of counts, whose size does not depend on the input. Every pass over
texts and candidates is made of DataFrame functions. Candidates, not texts, go through the shuffle, dealt
by document; patterns are written so that no match is tried twice from inside one run of characters.

Defined results: null text is empty, empty text has no spans. Texts of any length are read as a whole.
Every row is judged for itself, also if its doc_id is null or occurs again. An added span never overlaps
a base one, and where added spans of two kinds overlap, the kind listed first stays. Without candidates
nothing is fitted; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, staged

KINDS = ("email", "ip", "card", "phone")
#: Probability from which a candidate is added.
THRESHOLD = 0.9
#: Rounds of expectation-maximisation and of gradient steps.
EM_ROUNDS, FIT_ROUNDS = 40, 300

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The contract's patterns. A match starts where a run starts, or where the last match ended.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:\x20?@\x20?|\x20?[\[({]at[\])}]\x20?|\x20at\x20)", r"(?:\.|\x20?[\[({]dot[\])}]\x20?|\x20dot\x20)"
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+{_AT}{_LABEL}{{1,63}}+(?:{_DOT}{_LABEL}{{1,63}}+){{1,6}}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
    r"|(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
    "phone": r"(?<![0-9+])(?:(?:\+|00)[1-9][0-9]{0,2}[\x20.-]?)?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
_PART = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_IP = rf"^0*{_PART}\.0*{_PART}\.0*{_PART}\.0*{_PART}$"

# Gazetteers, fixed values.
_DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|name|io|ai|app|dev|de|at|ch|fr|be|es|mx|ar|it|pt|br|nl|pl|se|no|dk|fi|uk|ie|us|ca|au|nz|in|jp|cn|kr|ru|eu"
_ISSUERS = (
    r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}"
    r"|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|4[4-9][0-9]|5[0-9]{2})[0-9]{12}|35(?:2[89]|[3-8][0-9])[0-9]{12})$"
)
_RESERVED = r"^0*(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
_CALLING = r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[7-9][0-9]|8[057][0-9]|9[679][0-9])"
_FOR = {
    "email": r"\b(?:e-?mail|mail|contact|write to|reach|correo|courriel|kontakt|adresse)\b",
    "ip": r"\b(?:ip|host|server|addr|address|from|client|adresse|direcci[oó]n)\b",
    "card": r"\b(?:card|credit|visa|mastercard|amex|pay|paid|karte|tarjeta|carte)\b",
    "phone": r"\b(?:tel|phone|call|mobile|cell|fax|telefon|handy|t[eé]l[eé]phone|tel[eé]fono)\b",
}
_AGAINST = r"(?:\b(?:version|ver|release|order|invoice|isbn|issn|serial|token|hash|section|id|no|nr)\b\.?|[#$=])\W{0,3}$"

#: Values of the features: kind of value, separators, character before, character after, structure.
_SIZES = {"size": 21, "style": 5, "before": 4, "after": 4, "strong": 2}
FEATURE_ROWS = math.prod(_SIZES.values())
VOTES = ("pattern", "structure", "gazetteer", "context", "border")


def _digits(found: str) -> str:
    return f"regexp_replace({found}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    one = f"int(substr({digits}, -i, 1))"
    doubled = f"2 * {one} - 9 * int({one} > 4)"
    return f"aggregate(sequence(1, greatest(1, length({digits}))), 0, (a, i) -> a + if(i % 2 = 0, {doubled}, {one})) % 10 = 0"


def _valid(kind: str) -> Column:
    """Whether a match of the pattern counts; `digits` are its digits."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.col("found").rlike(_IP) | F.col("found").contains(":")
    if kind == "card":
        return F.expr(f"if(length(digits) between 13 and 19, {_luhn('digits')}, false)")
    # Groups of digits alone are any numbers: something must say that this is one to call.
    said = F.col("found").rlike(r"^(?:\+|00)[1-9]") | F.col("found").contains("(") | F.lower("tail").rlike(_FOR["phone"])
    return F.length("digits").between(9, 15) & said


def _pieces(text: Column, which: int, pattern: str) -> Column:
    """A pattern's matches, each with the gap before it, and last the gap that remains; none without a match."""
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")
    )
    each = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(which).alias("which"),
            i.alias("seq"),
            F.length(x["gap"]).alias("gap"),
            F.left(x["gap"], F.lit(1)).alias("head"),
            F.right(x["gap"], F.lit(24)).alias("tail"),
            x["found"].alias("found"),
        ),
    )
    return F.when(text.rlike(pattern), each).otherwise(F.array().cast(_PIECES))


_PIECES = "array<struct<which:int,seq:int,gap:int,head:string,tail:string,found:string>>"
_DOCUMENT = 2 * len(KINDS)


def _by_kind(values: dict[str, Column]) -> Column:
    out = F.lit(None)
    for n, kind in enumerate(KINDS):
        out = F.when(F.col("kind") == n, values[kind]).otherwise(out)
    return out


def _sign(yes: Column, no: Column | None = None) -> Column:
    otherwise = F.lit(0) if no is None else F.when(no, -1).otherwise(0)
    return F.when(yes, 1).otherwise(otherwise).cast("int")


def _class_of(char: Column) -> Column:
    """0 nothing, 1 white space, 2 punctuation, 3 letter or digit."""
    kind = F.when(char.rlike(r"^\s"), 1).when(char.rlike(r"^[\p{L}\p{N}_=@/\\+]"), 3).otherwise(2)
    return F.when(char == "", 0).otherwise(kind)


def _described(pieces: DataFrame) -> DataFrame:
    """Checks, votes and features that a match and the text before it give."""
    found, context = F.col("found"), F.lower("tail")
    strict = {
        "email": found.rlike(rf"^{_LOCAL}+@{_LABEL}+(?:\.{_LABEL}+)+$"),
        "ip": found.rlike(r"^[0-9.]+$"),
        "card": F.lit(True),
        "phone": found.startswith("+"),
    }
    parts = F.length(F.regexp_replace("found", "[^ .()-]", ""))
    structure = {
        "email": _sign(
            found.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?\W.*[^A-Za-z][A-Za-z]{2,}$"), found.rlike(r"^[.-]|[.-]$|[0-9-]$")
        ),
        "ip": _sign(~found.rlike(r"(?:^|\.)0[0-9]"), found.rlike(r"(?:^|\.)0[0-9]")),
        "card": _sign(~found.rlike(r"([0-9])\1{7}"), found.rlike(r"([0-9])\1{7}")),
        "phone": _sign(F.length("digits").between(10, 13) & (parts > 1), F.length("digits") < 9),
    }
    gazetteer = {
        "email": _sign(F.lower("found").rlike(rf"[^a-z0-9-](?:{_DOMAINS})$")),
        "ip": _sign(F.lit(False), found.rlike(_RESERVED)),
        "card": _sign(F.col("digits").rlike(_ISSUERS), ~F.col("digits").rlike(_ISSUERS)),
        "phone": _sign(found.rlike(_CALLING) | found.contains("(")),
    }
    size = {"email": F.length(F.regexp_extract("found", r"([A-Za-z0-9-]*)$", 1)), **{k: F.length("digits") for k in KINDS[1:]}}
    style = (
        F.when(found.contains("("), 4)
        .when(found.contains(" ") & found.contains("-"), 3)
        .when(found.contains(" "), 2)
        .when(found.contains("-"), 1)
        .otherwise(0)
    )
    ctx = _by_kind({k: _sign(context.rlike(_FOR[k]), context.rlike(_AGAINST)) for k in KINDS})
    return pieces.withColumns(
        {
            "valid": _by_kind({k: _valid(k) for k in KINDS}),
            "pattern": _sign(_by_kind(strict)),
            "structure": _by_kind(structure),
            "gazetteer": _by_kind(gazetteer),
            "context": ctx,
            "size": F.least(_by_kind(size), F.lit(_SIZES["size"] - 1)),
            "style": style,
            "before": _class_of(F.right("tail", F.lit(1))),
        }
    )


def candidates(docs: DataFrame) -> DataFrame:
    """Spans of every document: row, doc_id, kind, base, start, stop, votes and features; and one row a document without a kind.

    Loose spans that meet a base span are left out. Written to the shared folder.
    """
    text = F.coalesce("text", F.lit(""))
    patterns = [*BASE.values(), *LOOSE.values()]
    mark = F.struct(F.lit(_DOCUMENT), F.lit(0), F.lit(0), F.lit(""), F.lit(""), F.lit(None).cast("string"))
    every = F.concat(F.array(mark).cast(_PIECES), *[_pieces(text, n, p) for n, p in enumerate(patterns)])
    rows = numbered(docs.select("doc_id", "text"), "row")
    pieces = rows.select("row", "doc_id", F.explode(every).alias("piece")).select("row", "doc_id", "piece.*")
    pieces = pieces.withColumns(
        {
            "kind": F.when(F.col("which") < _DOCUMENT, F.col("which") % len(KINDS)),
            "digits": F.expr(_digits("found")),
            "long": F.coalesce(F.length("found"), F.lit(0)),
        }
    )
    order = Window.partitionBy("row", "which").orderBy("seq")
    placed = (
        _described(pieces)
        .drop("found", "digits", "tail")
        .withColumns(
            {
                "stop": F.sum(F.col("gap").cast("long") + F.col("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)),
                "next": F.lead("head").over(order),
            }
        )
        .withColumn("start", F.col("stop") - F.col("long"))
        .withColumn("after", _class_of(F.coalesce("next", F.lit(""))))
    )
    letters = (F.col("before") == 3) | (F.col("after") == 3)
    spans = placed.where(f"which = {_DOCUMENT} or valid and long > 0").select(
        "row",
        "doc_id",
        "kind",
        (F.col("which") < len(KINDS)).alias("base"),
        "start",
        "stop",
        *VOTES[:4],
        _sign(~letters, letters).alias("border"),
        "size",
        "style",
        "before",
        "after",
        F.when(F.col("structure") > 0, 1).otherwise(0).alias("strong"),
    )
    return staged(_apart(spans, F.col("base") & F.col("kind").isNotNull(), ~F.col("base") & F.col("kind").isNotNull()), "spans")


def _apart(spans: DataFrame, firm: Column, tested: Column) -> DataFrame:
    """Drop tested spans that meet a firm one, which starts before or after them."""
    marked = spans.withColumn("_firm", F.coalesce(firm, F.lit(False)))
    back = [F.col("_firm").desc(), "stop"]
    forwards = Window.partitionBy("row").orderBy("start", *back).rowsBetween(Window.unboundedPreceding, -1)
    backwards = Window.partitionBy("row").orderBy(F.desc("start"), *back).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("_firm"), F.col("stop"))).over(forwards)
    ahead = F.min(F.when(F.col("_firm"), F.col("start"))).over(backwards)
    free = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.col("stop")) >= F.col("stop"))
    kept = marked.withColumn("_free", free).where(F.col("_free") | ~F.coalesce(tested, F.lit(False)))
    return kept.drop("_free", "_firm")


def estimate(counted: list[tuple[int, tuple[int, ...], int]]) -> dict[tuple[int, tuple[int, ...]], float]:
    """(kind, votes, count) → probability that a candidate with these votes is private, by expectation-maximisation.

    Each labeler has a table P(vote | class) per kind; a Dirichlet prior of a tenth of the candidates,
    in which labelers are mostly right, keeps the two classes from changing places.
    """
    out = {}
    for kind in {k for k, _, _ in counted}:
        rows = [(v, n) for k, v, n in counted if k == kind]
        total = sum(n for _, n in rows)
        weight = 10 + 0.1 * total
        belief = [1 / (1 + math.exp(-1.5 * sum(v))) for v, _ in rows]
        for _ in range(EM_ROUNDS):
            share = (0.5 * weight + sum(b * n for b, (_, n) in zip(belief, rows, strict=True))) / (weight + total)
            tables = []
            for j in range(len(VOTES)):
                sides = [{1: 0.6 * weight, 0: 0.3 * weight, -1: 0.1 * weight}, {1: 0.1 * weight, 0: 0.3 * weight, -1: 0.6 * weight}]
                for b, (v, n) in zip(belief, rows, strict=True):
                    sides[0][v[j]] += b * n
                    sides[1][v[j]] += (1 - b) * n
                tables.append([{x: c / sum(side.values()) for x, c in side.items()} for side in sides])
            belief = []
            for v, _ in rows:
                odds = math.log(share / (1 - share)) + sum(math.log(t[0][x] / t[1][x]) for t, x in zip(tables, v, strict=True))
                belief.append(1 / (1 + math.exp(-max(-50.0, min(50.0, odds)))))
        out |= {(kind, v): b for (v, _), b in zip(rows, belief, strict=True)}
    return out


def fit(rows: list[tuple[int, tuple[int, ...], float, int]]) -> dict[int, dict[tuple[str, int], float]]:
    """(kind, features, sum of probabilities, count) → per kind the weight of each feature's value, ("", 0) being the bias.

    A logistic regression with soft labels, by gradient steps over the counted rows; a small penalty keeps rare values near zero.
    """
    weights = {}
    for kind in {r[0] for r in rows}:
        own = [([("", 0), *zip(_SIZES, values, strict=True)], s, n) for k, values, s, n in rows if k == kind]
        total = sum(n for _, _, n in own)
        w = dict.fromkeys((x for names, _, _ in own for x in names), 0.0)
        for _ in range(FIT_ROUNDS):
            slope = {x: -0.001 * v for x, v in w.items()}
            for names, s, n in own:
                rest = (s - n / (1 + math.exp(-sum(w[x] for x in names)))) / total
                for x in names:
                    slope[x] += rest
            w = {x: v + 2.0 * slope[x] for x, v in w.items()}
        weights[kind] = w
    return weights


def _score(weights: dict[int, dict[tuple[str, int], float]]) -> Column:
    """The classifier as an expression."""
    out = F.lit(-50.0)
    for kind, w in weights.items():
        odds = F.lit(w["", 0])
        for name in _SIZES:
            table = {v: x for (n, v), x in w.items() if n == name}
            pairs = [F.lit(y) for pair in table.items() for y in pair]
            odds = odds + F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(name).cast("int")), F.lit(0.0))
        out = F.when(F.col("kind") == kind, odds).otherwise(out)
    return 1 / (1 + F.exp(-out))


def train(spans: DataFrame) -> dict[int, dict[tuple[str, int], float]]:
    """Reliabilities from the votes of all candidates, then the classifier from their posteriors."""
    found = spans.where("kind is not null")
    votes = found.groupBy("kind", *VOTES).agg(F.count("*").alias("n")).collect()
    beliefs = estimate([(r.kind, tuple(r[v] for v in VOTES), r.n) for r in votes])
    if not beliefs:
        return {}
    text = F.concat_ws(":", "kind", *VOTES)
    table = F.create_map(*(F.lit(y) for (k, v), b in beliefs.items() for y in (":".join(map(str, (k, *v))), b)))
    soft = found.withColumn("belief", F.try_element_at(table, text))
    counted = soft.groupBy("kind", *_SIZES).agg(F.sum("belief").alias("s"), F.count("*").alias("n")).collect()
    return fit([(r.kind, tuple(r[f] for f in _SIZES), r.s, r.n) for r in counted])


def find_private(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents (doc_id, text) → doc_id, base counts by kind, base_sha256, spans, n_added; one row per document."""
    spans = candidates(docs)
    score = F.when(F.col("base"), 1.0).otherwise(_score(train(spans)))
    chosen = spans.withColumn("score", score).where(F.col("kind").isNull() | (F.col("score") >= threshold))
    # Matches of one pattern never overlap; where added spans of two kinds do, the kind named first stays.
    final = chosen
    for n in range(1, len(KINDS)):
        final = _apart(final, F.col("kind") < n, (F.col("kind") == n) & ~F.col("base"))

    def listed(which: Column) -> Column:
        spans = F.sort_array(F.collect_list(F.when(which, F.struct("kind", "start", "stop"))))
        name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"], x["stop"])), ",")

    base, some = F.col("base"), F.col("kind").isNotNull()
    return final.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.count_if(base & (F.col("kind") == n)).alias(f"n_{k}") for n, k in enumerate(KINDS)],
        F.sha2(listed(base & some), 256).alias("base_sha256"),
        listed(some).alias("spans"),
        F.count_if(some & ~base).alias("n_added"),
    ).drop("row")
