"""Personal data by weak supervision.

Wide patterns propose spans. On each, five labelers vote for, against or not at all: the pattern's strict form, a
checksum or range check, a gazetteer (top-level domains, calling codes, card issuers, reserved networks, secret words),
cue words in the text before, and whether the span stands alone. Expectation-maximisation over the counts of vote
patterns (Dawid and Skene, 1979) estimates how reliable each labeler is on each kind, without labels; its posteriors
then train the span classifier, a log-odds sum over the span's kind, votes, length and neighbours, which decides.
Spans that the base rules find stay whatever it says, and a proposed span that touches a base span is dropped.

All of it runs on built-in functions. Offsets are code points, counted from the pieces between matches. Texts are read
once; all that follows works on the proposed spans, and only counts per vote pattern and trait reach the driver: their
number is bounded by the kinds, votes and trait values listed here.

Defined results: a null or empty text has no span; repeated rows are handled one by one; an empty table gives no rows
and learns nothing; columns other than doc_id and text are ignored, whatever their names.
"""
from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import let, stored, table
from turnwise.llm.registry import query

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kind to (cheap test that must hold, pattern). Patterns never retry: their parts can't give characters back usefully.
PATTERNS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[ -]?[0-9]){15}", r"[0-9](?:[ -]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    "secret": (r"[A-Za-z0-9]{24}", r"(?<![A-Za-z0-9])[A-Za-z0-9]{24,}+"),
    # led by a cue word, of any shape and from eight characters on
    "keyed_secret": (r"(?i)(?:token|secret|passw|key|credential|bearer|pwd)",
                     r"(?i)(?<=(?:token|secret|password|passwd|pwd|api[_ -]?key|access[_ -]?key|credential|credentials|bearer)[\"' \t:=]{1,6})"
                     r"[A-Za-z0-9_+/=~!@#$%^&*-]{8,}+"),
    "national_id": (r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "local_phone": (r"[0-9][ .-][0-9]{4}", r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Gazetteers, as patterns on a span.
KNOWN = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ca|au|ch|at|nl|be|it|pl|jp|cn|in|br|ru)$",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "local_phone": r"^\(?[2-9]",
    "national_id": r"^(?!000|666|9)",
    "secret": r"^(?=.*[0-9])(?=.*[A-Za-z])",
    "keyed_secret": r"^(?=.*[0-9])(?=.*[A-Za-z])",
    "ip": r"^(?!0|127\.|255\.|22[4-9]\.|23[0-9]\.)",
}
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|correo|courriel|mailto)",
    "ip": r"(?i)(?:\bip\b|host|server|address|login)",
    "card": r"(?i)(?:card|visa|master|credit|karte|tarjeta|carte)",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|telefon)",
    "local_phone": r"(?i)(?:phone|tel|call|mobile|fax|telefon)",
    "national_id": r"(?i)(?:ssn|social|insurance|\bid\b)",
    "secret": r"(?i)(?:token|secret|passw|api.?key|credential|bearer)",
    "keyed_secret": r"(?i)(?:token|secret|passw|pwd|key|credential|bearer)",
}
LABELERS = ("form", "check", "gazetteer", "context", "alone")
_BLOCK = 256


def _matches(text: Column, pattern: str) -> Column:
    """(start, stop, hit, before, after) of each match; before: up to 40 characters since the last match."""
    piece_of = "struct<start:int,stop:int,hit:string,before:string,after:string>"

    def placed(found: Column) -> Column:
        def width(x: Column) -> Column:
            return F.length(x["part"]) + F.length(x["hit"])

        def in_block(b: Column, starts: Column) -> Column:
            zero = F.struct(starts[b].alias("at"), F.array().cast(f"array<{piece_of}>").alias("out"))

            def add(a: Column, x: Column) -> Column:
                start = a["at"] + F.length(x["part"])
                stop = start + F.length(x["hit"])
                one = F.struct(start.alias("start"), stop.alias("stop"), x["hit"].alias("hit"),
                               F.right(x["part"], F.lit(40)).alias("before"), F.left(x["next"], F.lit(1)).alias("after"))
                return F.struct(stop.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

            return F.aggregate(F.slice(found, b * _BLOCK + 1, _BLOCK), zero, add, lambda a: a["out"])

        # Sums run block by block, so a text with very many matches never copies its whole list for each of them.
        blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _BLOCK).cast("int"))
        widths = F.transform(blocks, lambda b: F.aggregate(
            F.slice(found, b * _BLOCK + 1, _BLOCK), F.lit(0), lambda a, x: a + width(x)))
        starts = F.aggregate(
            widths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, w: F.struct((a["at"] + w).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
            lambda a: a["out"])
        return let(starts, lambda s: F.flatten(F.transform(blocks, lambda b: in_block(b, s))))

    def joined(parts: Column) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        shifted = F.slice(parts, F.lit(2), F.size(parts))
        return F.transform(F.arrays_zip(F.slice(parts, F.lit(1), F.size(parts) - 1), hits, shifted),
                           lambda z: F.struct(z["0"].alias("part"), z["1"].alias("hit"), z["2"].alias("next")))

    none = F.array().cast(f"array<{piece_of}>")
    pieces = let(F.split(text, pattern, -1), lambda p: joined(p))
    return let(pieces, lambda f: F.when(F.size(f) > 0, placed(f)).otherwise(none))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a short string of digits passes the Luhn check."""
    reverse = F.split(F.reverse(digits), "")

    def weight(d: Column, i: Column) -> Column:
        twice = 2 * d.cast("int")
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d.cast("int"))

    return F.aggregate(F.transform(F.filter(reverse, lambda d: d != ""), weight), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    """The base rule's own test of a match; for proposed kinds, what makes one plausible."""
    if kind == "ip":
        return hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return let(_digits(hit), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    if kind == "secret":
        return F.length(_digits(hit)).between(4, F.length(hit) - 4)
    if kind == "keyed_secret":
        return hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
    if kind == "national_id":
        return ~hit.rlike(r"-00-|-0000$")
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _side(x: Column) -> Column:
    return (F.when(x == "", "edge").when(x.rlike(r"\s"), "space").when(x.rlike(r"\p{L}"), "letter")
            .when(x.rlike(r"[0-9]"), "digit").otherwise("mark"))


def _judged(kind: str, m: Column) -> Column:
    """A match with its votes and traits."""
    hit, left, right = m["hit"], F.right(m["before"], F.lit(1)), m["after"]
    valid = _valid(kind, hit)
    plain = hit.rlike({"card": r"^(?:[0-9]{16,19}|[0-9]{4}(?:[ -][0-9]{4}){3})$",
                       "phone": r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}$",
                       "secret": r"^(?:[0-9a-f]+|[0-9A-F]+)$",
                       "keyed_secret": r"^(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])|[_+/=~!@#$%^&*-]|^(?:[A-Z0-9]+|[a-z]*[0-9]+[a-z0-9]*)$",
                       "ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"}.get(kind, ".")).alias("plain")
    touches = left.rlike(r"[\p{L}0-9]") | right.rlike(r"[\p{L}0-9]")
    votes = F.array(
        _vote(plain, ~plain), _vote(valid, ~valid),
        _vote(hit.rlike(KNOWN[kind]), F.lit(kind in ("secret", "keyed_secret", "ip", "national_id")) & ~hit.rlike(KNOWN[kind])),
        _vote(m["before"].rlike(CUES[kind] + r"[^.\n]{0,20}$"), F.lit(False)), _vote(~touches, touches))
    length = F.least(F.floor(F.log2(F.length(hit))), F.lit(8)).cast("string")
    traits = F.array(F.concat(F.lit(f"{kind}:length:"), length), F.concat(F.lit(f"{kind}:left:"), _side(left)),
                     F.concat(F.lit(f"{kind}:right:"), _side(right)),
                     F.concat(F.lit(f"{kind}:votes:"), F.array_join(votes.cast("array<string>"), ",")))
    base = valid if kind in BASE_KINDS else F.lit(False)
    return F.struct(F.lit(kind).alias("kind"), base.alias("base"), m["start"].alias("start"), m["stop"].alias("stop"),
                    votes.alias("votes"), traits.alias("traits"))


_SPAN = "array<struct<kind:string,base:boolean,start:int,stop:int,votes:array<int>,traits:array<string>>>"


def proposed_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the proposed spans of every row, by kind as listed, then by start."""
    text = F.col("_text")
    found = []
    for kind, (test, pattern) in PATTERNS.items():
        spans = F.transform(_matches(text, pattern), _judge_of(kind))
        found.append(F.when(text.rlike(test), spans).otherwise(F.array().cast(_SPAN)))
    raw = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).select("doc_id", F.concat(*found).alias("all"))

    def free(spans: Column) -> Column:
        base = F.filter(spans, lambda s: s["base"])
        meets = lambda s, b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])
        alone = let(base, lambda bs: F.filter(spans, lambda s: s["base"] | ~F.exists(bs, lambda b: meets(s, b))))
        # a secret found as such isn't found once more for the cue before it
        return let(alone, lambda held: F.filter(held, lambda s: (s["kind"] != "keyed_secret") | ~F.exists(
            held, lambda b: (b["kind"] != "keyed_secret") & meets(s, b))))

    return raw.select("doc_id", F.when(F.size("all") > 0, let(F.col("all"), free)).otherwise(F.col("all")).alias("spans"))


def _judge_of(kind: str):
    return lambda m: _judged(kind, m)


def vote_posteriors(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 60) -> dict[tuple, float]:
    """Probability that spans of a kind with given votes are real, by expectation-maximisation per kind.

    Each labeler has, for real and for other spans, a distribution over its three votes. Pseudo-counts start it out as
    better than chance, which also settles which of the two classes is the real one.
    """
    posterior = {key: (0.9 if sum(key[1]) > 0 else 0.1 if sum(key[1]) < 0 else 0.5) for key in counts}
    for kind in sorted({k for k, _ in counts}):
        own = {votes: n for (k, votes), n in counts.items() if k == kind}
        for _ in range(rounds):
            total = sum(own.values())
            real = sum(n * posterior[kind, v] for v, n in own.items())
            prior = (real + 1) / (total + 2)
            tables = []
            for labeler in range(len(LABELERS)):
                yes = {-1: 0.5, 0: 1.0, 1: 2.0}
                no = {-1: 2.0, 0: 1.0, 1: 0.5}
                for v, n in own.items():
                    yes[v[labeler]] += n * posterior[kind, v]
                    no[v[labeler]] += n * (1 - posterior[kind, v])
                tables.append([{x: c / sum(t.values()) for x, c in t.items()} for t in (yes, no)])
            change = 0.0
            for v in own:
                odds = math.log(prior / (1 - prior)) + sum(
                    math.log(t[0][x] / t[1][x]) for t, x in zip(tables, v))
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
                change = max(change, abs(p - posterior[kind, v]))
                posterior[kind, v] = p
            if change < 1e-6:
                break
    return posterior


def _lookup(values: dict[str, float], key: Column, default: float) -> Column:
    if not values:
        return F.lit(default)
    pairs = [F.lit(x) for k, v in sorted(values.items()) for x in (k, float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def train_span_classifier(proposed: DataFrame) -> dict[str, float]:
    """Log-odds by trait, and by kind alone, from the posteriors of the vote patterns."""
    spans = proposed.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.traits")
    counts = {(r["kind"], tuple(r["votes"])): r["n"]
              for r in spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()}
    real = {f"{kind}:{','.join(map(str, votes))}": p for (kind, votes), p in vote_posteriors(counts).items()}
    name = F.concat_ws(":", "kind", F.array_join(F.col("votes").cast("array<string>"), ","))
    traits = spans.select("kind", _lookup(real, name, 0.5).alias("p"), F.explode(
        F.concat(F.array("kind"), "traits")).alias("trait"))
    sums: dict[str, tuple[float, float]] = {
        r["trait"]: (r["yes"], r["no"]) for r in traits.groupBy("trait").agg(
            F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()}
    return {t: math.log((yes + 0.5) / (no + 0.5)) if ":" not in t else
            math.log((yes + 0.5) / (sums[t.split(":")[0]][0] + 1)) - math.log((no + 0.5) / (sums[t.split(":")[0]][1] + 1))
            for t, (yes, no) in sums.items()}


def decided_spans(proposed: DataFrame, weights: dict[str, float]) -> DataFrame:
    """doc_id and the spans that stay: base ones and those the classifier accepts; each has its score.

    A match of a base pattern that fails its rule (a checksum, a range, a number of digits) is never added: it only
    teaches the classifier what such spans look like.
    """
    def scored(s: Column) -> Column:
        total = F.aggregate(F.concat(F.array(s["kind"]), s["traits"]), F.lit(0.0),
                            lambda a, t: a + _lookup(weights, t, 0.0))
        return F.struct(s["kind"].alias("kind"), s["base"].alias("base"), s["start"].alias("start"),
                        s["stop"].alias("stop"), (1 / (1 + F.exp(-total))).alias("score"))

    kept = F.filter(F.transform("spans", scored), lambda s: s["base"] | (~s["kind"].isin(*BASE_KINDS) & (s["score"] >= 0.5)))
    return proposed.select("doc_id", F.when(F.size("spans") > 0, kept).alias("spans"))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, base, start, stop, score) of every row."""
    proposed = stored(proposed_spans(docs))
    return decided_spans(proposed, train_span_classifier(proposed))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


@query("op2_pii_votes")
def op2_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    spans = F.coalesce("spans", F.array().cast("array<struct<kind:string,base:boolean,start:int,stop:int,score:double>>"))
    found = found.select("doc_id", spans.alias("spans"), F.filter(spans, lambda s: s["base"]).alias("base"))
    number = [F.size(_of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *number, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"),
                        (F.size("spans") - F.size("base")).cast("long").alias("n_added"), (F.size("spans") > 0).alias("has_pii"))


def _of_kind(kind: str) -> Column:
    return F.filter("base", lambda s: s["kind"] == kind)
