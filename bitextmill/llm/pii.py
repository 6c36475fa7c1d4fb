"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a span
classifier decides.

DataFrame and SQL functions only. The text is scanned for the base spans of each kind (always kept); what they cover is
masked, and one more pattern finds wider candidates in the rest: obfuscated addresses, numbers without a plus sign, cards
with other separators, and credentials. Three labelers vote on each candidate (1 for, 0 abstain, -1 against): a strict
*pattern*, a *gazetteer* of domain endings, number prefixes and kinds of credentials, and the *context* of the 24
characters before it. The votes are counted per (kind, votes, shape), which is a table of fixed size whatever the corpus,
and expectation-maximisation estimates on those counts how reliable each labeler is. The final classifier is a logistic
model of votes and shape, trained on the estimated probabilities; a candidate whose probability is at least one half
becomes a span.

A scan parts the text into what is before each match and the match; places are sums of lengths, made in groups of GRAIN
parts, so the work is linear in the text and its matches. Very long texts are read whole, as one row.

Spans are code points, end exclusive. Nulls: a null text counts as empty, a null id stays null. Empty tables give no
rows, repeated rows repeat, other columns are ignored by ``find`` and kept by ``redacted``. Ties: spans of different
kinds may overlap in ``find``; ``redacted`` replaces in the order of the kinds, so the first kind takes the place.
"""

from __future__ import annotations

import functools
import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

LOCAL = "A-Za-z0-9._%+-"
#: Each pattern starts where a run of its characters starts or where the last match ended: the same leftmost matches as
#: without, in linear time. Shorter digit chains can never be cards, so the card pattern asks for 13 digits at once.
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(BASE)
#: What a text must hold for the pattern to be tried at all.
GATE = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Wider candidates, by kind: alternatives of one pattern.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\}|(?<=\x20)at(?=\x20))\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|(?<=\x20)dot(?=\x20)|\.)\x20?[A-Za-z0-9-]{1,24}){1,4}",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?<mark>[._/])[0-9]{4}\k<mark>[0-9]{4}\k<mark>[0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_])(?i:password|passwd|pwd|token|secret|api[_-]?key)\x20?[=:]\x20?\x22?[A-Za-z0-9+/_.~=-]{8,}(?<!\.)\x22?",
}
#: What a text must hold for an address among them to be tried, or else for the others.
AT_GATE = r"[(\[{\x20]at[)\]}\x20]\x20?[A-Za-z0-9-]{1,64}(?:\x20?[(\[{]dot[)\]}]|\x20dot\x20|\x20?\.\x20?[A-Za-z0-9-])"
WIDE_GATE = r"[0-9]{4}[._/][0-9]{4}|[0-9]{3}[-.\x20][0-9]{4}|(?i:pass|pwd|token|secret|key)[A-Za-z]*\x20?[=:]"
NO_ADDRESS = "|".join(f"(?:{WIDE[k]})" for k in ("secret", "card", "phone"))
ANY_WIDE = f"{NO_ADDRESS}|(?:{WIDE['email']})"
#: What tells the kind of a candidate; what is left is an email.
TELLS = {"secret": r"^(?i:password|passwd|pwd|token|secret|api[_-]?key)\x20?[=:]", "card": r"^[0-9]{4}[._/][0-9]{4}[._/]", "phone": r"^(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}$"}
#: Parts of a scan whose places are summed together.
GRAIN = 128
#: Noncharacters that stand for masked text: two a base kind, for its first character and the others; one to escape them
#: where a text holds them, with the codes that then stand for each.
MASKS = {k: (chr(0xFDD0 + 2 * i), chr(0xFDD1 + 2 * i)) for i, k in enumerate(KINDS)}
ESCAPE = "\uFDD8"
ESCAPES = [(ESCAPE, ESCAPE + "\uFDE8"), *((chr(0xFDD0 + i), ESCAPE + chr(0xFDE0 + i)) for i in range(8))]
#: Gazetteers: fixed values.
ENDINGS = r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$"
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
AREA_CODE = r"^\(?[2-9][0-9]{2}"
CREDENTIAL = r"^(?:sk[-_]|pk[-_]|gh[pousr]_|xox[abp]-|AKIA|AIza|eyJ|glpat-)"
PLACEHOLDER = r"(?i)^(?:x{8}|example|changeme|placeholder|your[_-]|required|optional|undefined)"
CUES = {
    "email": r"(?i)(?:mail|contact|write|reach|address)[^\n]{0,16}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|pay|account)[^\n]{0,16}$",
    "phone": r"(?i)(?:phone|call|tel|mobile|fax|dial|contact)[^\n]{0,16}$",
    "secret": r"(?i)(?:login|user|auth|key|credential|config)[^\n]{0,16}$",
}
AGAINST = r"(?i)(?:version|isbn|order|page|figure|table|chapter|serial)[^\n]{0,12}$"
LABELERS = 3
WINDOW = 24


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def luhn(x: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    d = F.reverse(_digits(x))
    doubled = F.translate(d, "0123456789", "0246813579")  # digit sums of twice each digit
    one = lambda i: F.when(i % 2 == 1, F.substring(d, i, 1)).otherwise(F.substring(doubled, i, 1)).cast("int")
    size = F.length(d)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), F.lit(0), lambda acc, i: acc + F.coalesce(one(i), F.lit(0)))
    return size.between(13, 19) & (total % 10 == 0)


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(p.cast("decimal(38,0)"), F.lit(999)) <= 255)
        return F.forall(F.split(x, r"\."), part)
    if kind == "card":
        return luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _pairs(text: Column, pattern: str, gate: str) -> Column:
    """array<struct<p, m>>: the text before each match and the match; last the rest, without a match. Empty where ``gate``
    is not in the text."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return pairs if not gate else F.when(text.rlike(gate), pairs).otherwise(F.array().cast("array<struct<p:string,m:string>>"))


def _wide_pairs(text: Column) -> Column:
    return F.when(text.rlike(AT_GATE), _pairs(text, ANY_WIDE, "")).otherwise(_pairs(text, NO_ADDRESS, WIDE_GATE))


def _placed(pairs: Column, item, kind: str) -> Column:
    """array<``kind``> of ``item(pair, start)`` for every match, in order.

    Places are running sums. A fold over all parts would copy what it has at each step, so parts are summed in groups of
    GRAIN, groups are summed, and folds run inside a group only.
    """
    size = lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))

    def spans(pairs: Column) -> Column:
        groups = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(pairs) / F.lit(GRAIN)).cast("int") - 1, F.lit(0)))
        group = lambda k: F.slice(pairs, k * GRAIN + 1, GRAIN)

        def each(sums: Column) -> Column:
            def of(k: Column) -> Column:
                before = F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0), lambda a, n: a + n)
                return F.aggregate(
                    group(k),
                    F.struct(before.alias("at"), F.array().cast(f"array<{kind}>").alias("out")),
                    lambda acc, x: F.struct((acc["at"] + size(x)).alias("at"), F.when(x["m"].isNotNull(), F.concat(acc["out"], F.array(item(x, acc["at"] + F.length(x["p"]))))).otherwise(acc["out"]).alias("out")),
                    lambda acc: acc["out"],
                )

            return F.flatten(F.transform(groups, of))

        return _let(F.transform(groups, lambda k: F.aggregate(group(k), F.lit(0), lambda a, x: a + size(x))), each)

    return F.when(F.size(pairs) > 0, _let(pairs, spans)).otherwise(F.array().cast(f"array<{kind}>"))


def _joined_parts(pairs: Column, shown) -> Column:
    """The text again, each match as ``shown(pair)``."""
    return F.array_join(F.transform(pairs, lambda x: F.concat(x["p"], F.coalesce(shown(x), F.lit("")))), "")


def _masked(text: Column, kind: str, pairs: Column) -> Column:
    """The text with the valid matches of a base kind covered, character by character."""
    first, other = MASKS[kind]
    cover = lambda x: F.when(_valid(kind, x["m"]), F.concat(F.lit(first), F.repeat(F.lit(other), F.length(x["m"]) - 1))).otherwise(x["m"])
    return F.when(F.size(pairs) > 0, _joined_parts(pairs, cover)).otherwise(text)


def _masking(text: Column, kind: str):
    return lambda pairs: _masked(text, kind, pairs)


def _votes(x: Column) -> dict[str, Column]:
    """Kind, pattern, gazetteer and context votes, and shape (0 short, 1 long) of one candidate; nulls where none is."""
    m, before = x["m"], F.right(x["p"], F.lit(WINDOW))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    value = F.regexp_extract(m, r"[=:]\x20?\x22?(.*?)\x22?$", 1)
    pattern = {
        "email": vote(m.rlike(r"[(\[{](?:at|dot)[)\]}]"), ~m.rlike(r"dot|\.") | m.rlike(r"^[a-z]+\x20at\x20")),
        "card": vote(luhn(m), F.lit(True)),
        "phone": vote(m.rlike(r"^\("), m.rlike(r"\x20.*\x20")),
        "secret": vote(value.rlike(r"[0-9]") & value.rlike(r"[A-Za-z]") & (F.length(value) >= 12), ~value.rlike(r"[0-9]")),
    }
    gazetteer = {
        "email": vote(m.rlike(ENDINGS), F.lit(True)),
        "card": vote(m.rlike(CARD_PREFIX), F.lit(True)),
        "phone": vote(m.rlike(AREA_CODE), F.lit(True)),
        "secret": vote(value.rlike(CREDENTIAL), value.rlike(PLACEHOLDER)),
    }
    context = {k: vote(before.rlike(CUES[k]), before.rlike(AGAINST)) for k in WIDE}

    def by_kind(of: dict[str, Column]) -> Column:
        out = F.when(m.isNull(), F.lit(None))
        for k, tell in TELLS.items():
            out = out.when(m.rlike(tell), of[k])
        return out.otherwise(of["email"])

    return {"kind": by_kind({k: F.lit(k) for k in WIDE}), "v0": by_kind(pattern), "v1": by_kind(gazetteer), "v2": by_kind(context), "shape": (F.length(m) >= 16).cast("int")}


def _struct(columns: dict[str, Column]) -> Column:
    return F.struct(*(c.alias(name) for name, c in columns.items()))


_BASE = "struct<kind:string,s:int,e:int>"
_SPAN = "struct<kind:string,v0:int,v1:int,v2:int,shape:int,s:int,e:int>"
_PART = "struct<p:string,m:string,kind:string,v0:int,v1:int,v2:int,shape:int>"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of kind, s, e) and wide (array of candidates with their votes, s, e)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_text"))
    t = F.col("_text")
    rows = rows.select("*", *(_pairs(t, BASE[k], GATE[k]).alias(f"_{k}") for k in KINDS))

    def spans(k: str) -> Column:
        item = lambda x, at: F.struct(F.when(_valid(k, x["m"]), F.lit(k)).alias("kind"), at.alias("s"), (at + F.length(x["m"])).alias("e"))
        return F.filter(_placed(F.col(f"_{k}"), item, _BASE), lambda x: x["kind"].isNotNull())

    rows = rows.withColumn("base", F.concat(*map(spans, KINDS)))
    # a kind without a match in the text has none in the masked text
    for k in KINDS:
        again = _let(_pairs(t, BASE[k], GATE[k]), _masking(t, k))
        rows = rows.withColumn("_text", F.when(F.size(f"_{k}") > 0, again).otherwise(t))
    item = lambda x, at: _struct(_votes(x) | {"s": at, "e": at + F.length(x["m"])})
    rows = rows.select("doc_id", "base", _wide_pairs(t).alias("_wide"))
    return rows.select("doc_id", "base", _placed(F.col("_wide"), item, _SPAN).alias("wide"))


def reliabilities(counts: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[dict[int, tuple[float, float]]], list[float]]:
    """Expectation-maximisation over vote patterns with counts: prior, per labeler P(vote | span), P(vote | none), posteriors."""
    tables = [{v: ((0.6, 0.2) if v == 1 else (0.15, 0.5) if v == -1 else (0.25, 0.3)) for v in (-1, 0, 1)} for _ in range(LABELERS)]
    prior, post = 0.5, []
    for _ in range(rounds):
        post = []
        for votes, _n in counts:
            a, b = math.log(prior), math.log(1 - prior)
            for t, v in zip(tables, votes):
                a, b = a + math.log(t[v][0]), b + math.log(t[v][1])
            post.append(1 / (1 + math.exp(max(-60.0, min(60.0, b - a)))))
        weight = [n * p for (_, n), p in zip(counts, post)]
        other = [n - w for (_, n), w in zip(counts, weight)]
        # a few pseudo-votes keep labelers better than chance, which also fixes which class is which
        prior = (sum(weight) + 2) / (sum(weight) + sum(other) + 4)
        for k, t in enumerate(tables):
            for v, (yes, no) in {1: (1.8, 0.6), 0: (0.9, 0.9), -1: (0.6, 1.8)}.items():
                t[v] = (
                    (yes + sum(w for (votes, _), w in zip(counts, weight) if votes[k] == v)) / (3.3 + sum(weight)),
                    (no + sum(w for (votes, _), w in zip(counts, other) if votes[k] == v)) / (3.3 + sum(other)),
                )
    return prior, tables, post


def classifier(rows: list[tuple[tuple[int, ...], int, int, float]], steps: int = 400, rate: float = 0.5) -> list[float]:
    """Logistic weights (bias, for and against of each labeler, shape) from (votes, shape, count, probability)."""
    weights = [0.0] * (2 + 2 * LABELERS)
    total = sum(n for _, _, n, _ in rows) or 1
    for _ in range(steps):
        grad = [0.01 * w for w in weights]
        for votes, shape, n, p in rows:
            x = _inputs(votes, shape)
            z = sum(a * b for a, b in zip(weights, x))
            err = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n / total
            grad = [g + err * b for g, b in zip(grad, x)]
        weights = [w - rate * g for w, g in zip(weights, grad)]
    return weights


def _inputs(votes: tuple[int, ...], shape: int) -> list[float]:
    return [1.0, *(float(v == 1) for v in votes), *(float(v == -1) for v in votes), float(shape)]


def accepted(found: DataFrame) -> set[tuple]:
    """The (kind, votes, shape) of ``wide`` that the trained classifier accepts. Reads a table of at most 4 x 27 x 2 counts."""
    seen = found.select(F.explode("wide").alias("w")).where("w.kind is not null").groupBy("w.kind", "w.v0", "w.v1", "w.v2", "w.shape").count().collect()
    good = set()
    for kind in WIDE:
        rows = [((r[1], r[2], r[3]), r[4], r[5]) for r in seen if r[0] == kind]
        if not rows:
            continue
        _, _, post = reliabilities([(v, n) for v, _, n in rows])
        weights = classifier([(v, s, n, p) for (v, s, n), p in zip(rows, post)])
        for votes, shape in product(product((-1, 0, 1), repeat=LABELERS), (0, 1)):
            if sum(a * b for a, b in zip(weights, _inputs(votes, shape))) >= 0:
                good.add((kind, *votes, shape))
    return good


def _order(kind: Column) -> Column:
    names = [*KINDS, "secret"]
    return F.array_position(F.array(*map(F.lit, names)), kind)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _is_good(x: Column, good: set[tuple]) -> Column:
    """Whether a candidate is among the accepted ones."""
    keys = F.array(*(F.lit(":".join(map(str, g))) for g in sorted(good))) if good else F.array().cast("array<string>")
    return F.array_contains(keys, F.concat_ws(":", *(x[c].cast("string") for c in ("kind", "v0", "v1", "v2", "shape"))))


def _all_spans(good: set[tuple]) -> Column:
    span = lambda x: F.struct(_order(x["kind"]).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))
    return F.array_sort(F.concat(F.transform("base", span), F.transform(F.filter("wide", lambda x: _is_good(x, good)), span)))


def _number(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def find(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, counts and digest of the base spans, all spans. Columns as the contract names them."""
    rows = staged(candidates(docs), "pii")
    return rows.select("doc_id", *(_number(k) for k in KINDS), F.sha2(F.encode(_joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"), _joined(_all_spans(accepted(rows))).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text replaced by ``[kind]``; other columns as they are, null texts stay null.

    One scan: a text with anything to replace is written as its parts, base spans masked and candidates with their votes;
    when the votes of all are counted, parts are joined. n_chars, where there is such a column, is not recomputed: it
    describes the text as it was read.
    """
    t = F.col("_masked")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), text.alias("_masked"))
    rows = rows.withColumn("_own", t.rlike(f"[{MASKS['email'][0]}-{ESCAPE}]"))
    escaped = functools.reduce(lambda x, to: F.replace(x, *map(F.lit, to)), ESCAPES, t)
    rows = rows.withColumn("_masked", F.when(F.col("_own"), escaped).otherwise(t))
    for k in KINDS:
        rows = rows.withColumn("_pairs", _pairs(t, BASE[k], GATE[k])).withColumn("_masked", _masked(t, k, F.col("_pairs")))
    part = lambda x: _struct({"p": x["p"], "m": x["m"]} | _votes(x)).cast(_PART)
    rows = rows.withColumn("_pairs", _wide_pairs(t))
    whole = F.struct(t.alias("p"), *(F.lit(None).alias(c) for c in ("m", "kind", "v0", "v1", "v2", "shape"))).cast(_PART)
    parts = F.when(F.size("_pairs") > 0, F.transform("_pairs", part)).when(t.rlike("[" + "".join(a for a, _ in MASKS.values()) + "]"), F.array(whole))
    rows = staged(rows.select("doc", "_own", parts.alias("wide")), "pii")
    good = accepted(rows)
    out = _joined_parts(F.col("wide"), lambda x: F.when(_is_good(x, good), F.concat(F.lit("["), x["kind"], F.lit("]"))).otherwise(x["m"]))
    for k, (first, other) in MASKS.items():
        out = F.regexp_replace(out, f"{first}{other}*", f"[{k}]")
    plain = functools.reduce(lambda x, to: F.replace(x, F.lit(to[1]), F.lit(to[0])), reversed(ESCAPES), out)
    clean = F.when(F.col("wide").isNull() | F.col("doc")["text"].isNull(), F.col("doc")["text"]).when(F.col("_own"), plain).otherwise(out)
    return rows.withColumn("_clean", clean).select(*(F.col("_clean").alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns))
