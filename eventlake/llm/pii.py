"""Personal data by bootstrapped contextual extraction (operator 2).

Base matches of four kinds (email, ip, card, phone) are the seeds. What stands around a seed, as words, makes lexical patterns:
a kind, a side (words before, after) and the words. Whatever could be written for an identifier but is no base match (a number of
enough digits in any grouping, four numbers or eight hexadecimal ones, a word with an at sign or with at and dot written out) is a
candidate instance of each kind that its digits allow; which of them are identifiers is for the patterns to say. Spark
aggregates all (pattern, instance) pairs into a weighted graph and scores it in rounds: a pattern is as good as the
instances that it meets, shrunk towards a prior; an instance as likely as the patterns that meet it make it together (noisy
or), seeds being certain. A candidate that is the same identifier as a base match elsewhere is as certain, whatever stands around it.
A pattern that meets no seed counts in the rounds in which its score is above the prior, so that what is found leads to more, one
step further in each round. Scores only grow; rounds end when they hardly do, or after ROUNDS. Candidates of instances over the
threshold become spans, of overlapping ones the first. They never replace or overlap base ones.

Nulls and ties: a null or empty text has no spans and digests of an empty string. Repeated rows are kept, and each counts. Spans
are ordered by start, then by kind as listed. Texts of any length are read whole, in time that grows with their length. No
rows: no rows out. Other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import discard, settled, slices, spill

KINDS = ("email", "ip", "card", "phone")

#: The shapes of base matches.
_LOCAL, _DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_EMAIL_AT = re.compile(rf"{_LOCAL}++@{_DOMAIN}")
_EMAIL = re.compile(rf"(?<!{_LOCAL}){_LOCAL}++@{_DOMAIN}")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Candidates. An address: with at and dot written out, or any other word with an at sign. Numbers: in any grouping.
_NAME = re.compile(r"[A-Za-z0-9_%+-]{1,64}(?:\.[A-Za-z0-9_%+-]{1,64}){0,4}\Z")
_AT = re.compile(r"(?: ?[\[(] ?at ?[\])] ?| at )(?=[a-z0-9-]{1,63}(?: ?[\[(.]| dot ))(?:[a-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?| dot |\.)){1,4}[a-z0-9-]{1,63}", re.I)
_WORD_AT = re.compile(r"(?<![^\s<>(\[\"',;])[^\s<>()\[\]\"',;@\uff20]{1,64}[@\uff20][^\s<>()\[\]\"',;@\uff20]{1,128}(?<![.!?:])")
_HEX = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_FOUR = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|,|_| dot ) ?[0-9]{1,3}){3}(?![0-9])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,18}(?![0-9A-Za-z]|[.-][0-9])")
#: Digits that a number of a kind has, base matches aside.
DIGITS = {"card": (13, 19), "phone": (7, 15)}
#: What every text with a candidate address, or with any other candidate, has.
_MAYBE_AT = re.compile(r"[ \[(]at[ \])]", re.I)
_MAYBE = re.compile(r"[0-9](?:[\x20()./-]{0,2}[0-9]){6}|[0-9] ?(?:[\[(,_]| dot )|:[0-9A-Fa-f]{1,4}:")

#: Words of context on each side, and the characters in which they are looked for.
SIDE, REACH = 2, 80
#: The most rounds of scoring, and the share by which all scores must grow for one more; weight and value of a pattern's prior; the least
#: score and support of what is taken.
ROUNDS, GROWTH, PRIOR_WEIGHT, PRIOR, TAKE, SUPPORT = 10, 1e-4, 4.0, 0.02, 0.8, 3


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that do not overlap. A match may begin where the one before ended, even within a run of characters."""
    m = _EMAIL.search(text)
    while m:
        yield m.span()
        m = _EMAIL_AT.match(text, m.end()) or _EMAIL.search(text, m.end())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the base matches, in order."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _written_out(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with at and dot written as words or in brackets (a plain dot is enough where ``at`` stands in brackets)."""
    for m in _AT.finditer(text):
        if "dot" in m.group().lower() or m.group().lstrip()[0] in "[(":
            name = _NAME.search(text, max(0, m.start() - 128), m.start())
            if name:
                yield name.start(), m.end()


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that no base match overlaps; of overlapping ones of a kind the first stays."""
    found = []
    if _MAYBE_AT.search(text):
        found += [(a, 0, b) for a, b in _written_out(text)]
    if "@" in text or "\uff20" in text:
        found += [(m.start(), 0, m.end()) for m in _WORD_AT.finditer(text)]
    if _MAYBE.search(text):
        found += [(m.start(), 1, m.end()) for shape in (_HEX, _FOUR) for m in shape.finditer(text)]
        for m in _NUMBER.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            start = m.start() + (m.group()[0] == "(" and ")" not in m.group())
            fits = {k for k, (least, most) in DIGITS.items() if least <= len(digits) <= most}
            found += [(start, KINDS.index(k), m.end()) for k in fits if k != "card" or luhn(digits)]
    # ends of base matches up to each start grow with it, once the largest so far is taken
    starts, reach, out, taken = [a for a, _, _ in base], [0], [], [0] * len(KINDS)
    for _, _, b in base:
        reach.append(max(reach[-1], b))
    for a, kind, b in sorted(found):
        if a >= taken[kind] and reach[bisect_left(starts, b)] <= a:
            out.append((a, kind, b))
            taken[kind] = b
    return out


def contexts(text: str, start: int, end: int) -> tuple[str, str]:
    """The words before and after a span, lowered."""
    before = text[max(0, start - REACH) : start].lower().split()[-SIDE:]
    after = text[end : end + REACH].lower().split()[:SIDE]
    return " ".join(before), " ".join(after)


_AT_SIGN, _DOT_SIGN = re.compile(r" ?[\[(] ?at ?[\])] ?| at "), re.compile(r" ?[\[(] ?dot ?[\])] ?| dot ")


def instance(text: str, kind: int) -> str:
    """What stands for equal identifiers of a kind: an address with its signs, the parts of an ip, the digits of a number."""
    text = text.lower()
    if KINDS[kind] == "email":
        return text.replace("\uff20", "@") if "@" in text or "\uff20" in text else _DOT_SIGN.sub(".", _AT_SIGN.sub("@", text, count=1))
    if KINDS[kind] == "ip":
        return (":" if ":" in text else ".").join(part.lstrip("0") or "0" for part in re.findall("[0-9a-f]+", text))
    # 00 is how + is dialled
    return _NOT_DIGIT.sub("", text.removeprefix("00") if KINDS[kind] == "phone" else text)


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


_FOUND = "array<struct<kind:int,start:long,end:long,seed:boolean,instance:string,before:string,after:string>>"


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that stand for an id and a text."""
    return F.struct(*(F.xxhash64(F.lit(k), id_col, text_col).alias(f"h{k}") for k in range(2)))


def occurrences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (a hash of id and text) and found: base matches (seeds) and candidates of each text, with their contexts."""
    df = df.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    fields = [("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("instance", pa.string()), ("before", pa.string()), ("after", pa.string())]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                both = [(a, k, b, True) for a, k, b in base] + [(a, k, b, False) for a, k, b in loose_spans(text, base)]
                around = [contexts(text, a, b) for a, _, b, _ in both]
                out.append([
                    {"kind": k, "start": a, "end": b, "seed": seed, "instance": instance(text[a:b], k), "before": left, "after": right}
                    for (a, k, b, seed), (left, right) in zip(both, around, strict=True)
                ])
            found = pa.array(out, pa.list_(pa.struct(fields)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), found], names=["doc_id", "row", "found"])

    return df.mapInArrow(find, f"doc_id {dict(df.dtypes)['doc_id']}, row struct<h0:long,h1:long>, found {_FOUND}")


def edges(found: DataFrame) -> DataFrame:
    """The pattern-instance graph: pattern, kind, instance, seed, n (occurrences)."""
    flat = found.select(F.explode("found").alias("o")).select("o.*")
    sides = F.array(F.struct(F.lit("<").alias("side"), F.col("before").alias("words")), F.struct(F.lit(">").alias("side"), F.col("after").alias("words")))
    flat = flat.select("kind", "instance", "seed", F.explode(sides).alias("s")).where("s.words != ''")
    return flat.groupBy(F.xxhash64("kind", "s.side", "s.words").alias("pattern"), "kind", "instance", "seed").agg(F.count(F.lit(1)).alias("n"))


def _patterns(held: DataFrame, open_edges: DataFrame, scores: DataFrame) -> DataFrame:
    """pattern and value of those that count, given the scores of instances."""
    more = open_edges.join(scores, ["kind", "instance"]).groupBy("pattern").agg(F.sum(F.col("w") * F.col("score")).alias("more"))
    value = (F.col("good") + F.coalesce("more", F.lit(0.0)) + PRIOR_WEIGHT * PRIOR) / (F.col("all") + PRIOR_WEIGHT)
    out = held.join(more, "pattern", "left").where(f"all >= {SUPPORT}").withColumn("value", value)
    return out.where((F.col("good") > 0) | (F.col("value") > PRIOR)).select("pattern", "value")


def _instances(open_edges: DataFrame, patterns: DataFrame) -> DataFrame:
    doubt = F.exp(F.sum(F.log(F.lit(1.0) - F.least("value", F.lit(0.999)))))
    return open_edges.join(patterns, "pattern").groupBy("kind", "instance").agg((F.lit(1.0) - doubt).alias("score"))


def score_instances(graph: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind, instance, score of the instances that are not (or not only) seeds; 1 for those that are seeds elsewhere.

    In a pattern's mean each instance weighs by the logarithm of its count, so that copies of a text count little; each
    round is a grouped mean by pattern, a join and a grouped product by instance.
    """
    spark = graph.sparkSession
    graph = spill(graph, "graph")
    sure = graph.where("not seed").select("kind", "instance").distinct().join(graph.where("seed"), ["kind", "instance"], "left_semi")
    sure = spill(sure.withColumn("sure", F.lit(True)), "sure-instances")
    known = graph.join(sure, ["kind", "instance"], "left").withColumn("seed", F.col("seed") | F.coalesce("sure", F.lit(False)))
    known = known.groupBy("pattern", "kind", "instance", "seed").agg(F.sum("n").alias("n"))
    known = spill(known.withColumn("w", F.log1p("n")), "known-graph")
    discard(graph)
    open_edges = known.where("not seed")
    # what seeds add to a pattern never changes; patterns that meet only seeds score nothing
    good = F.sum(F.when(F.col("seed"), F.col("w")).otherwise(0.0))
    held = known.groupBy("pattern").agg(good.alias("good"), F.sum("w").alias("all"), F.bool_or(~F.col("seed")).alias("open"))
    held = spill(held.where("open").drop("open"), "patterns")
    scores, total = None, 0.0
    for _ in range(rounds):
        last = open_edges.select("kind", "instance").distinct().withColumn("score", F.lit(0.0)) if scores is None else scores
        found = settled(spark, lambda last=last: _instances(open_edges, spill(_patterns(held, open_edges, last), "pattern-scores")), "instance-scores")
        if scores is not None:
            discard(scores)
        scores, before, total = found, total, found.agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        if total - before <= GROWTH * total:
            break
    return scores.unionByName(sure.select("kind", "instance", F.lit(1.0).alias("score")))


_SPAN = "array<struct<start:long,kind:int,end:long>>"


def added_spans(found: DataFrame, take: float = TAKE) -> DataFrame:
    """row and added: the candidates whose instance scores ``take`` or more, of overlapping ones the first, of the rows that have any.
    Seeds score 1, also where a candidate has no context."""
    taken = score_instances(edges(found)).where(F.col("score") >= take).select("kind", "instance")
    seeds = found.select(F.explode(F.filter("found", lambda o: o["seed"])).alias("o")).select("o.kind", "o.instance")
    taken = taken.unionByName(seeds.where(F.lit(1.0) >= take))
    each = found.select("row", F.explode(F.filter("found", lambda o: ~o["seed"])).alias("o")).select("row", "o.*")
    each = each.join(taken, ["kind", "instance"], "left_semi")
    found = each.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).cast(_SPAN).alias("found"))
    apart = f"aggregate(found, cast(array() as {_SPAN}), (kept, s) -> if(size(kept) = 0 or get(kept, size(kept) - 1).end <= s.start, concat(kept, array(s)), kept))"
    return found.select("row", F.expr(apart).alias("added"))


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", take: float = TAKE) -> DataFrame:
    """doc_id, base and spans (start, kind, end; spans are base ones and those that the method adds) of every row."""
    found = spill(occurrences(df, id_col, text_col), "occurrences")
    base = F.transform(F.filter("found", lambda o: o["seed"]), lambda o: F.struct(o["start"], o["kind"], o["end"])).cast(_SPAN)
    out = found.join(added_spans(found, take), "row", "left").withColumn("base", base)
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_SPAN))))
    return out.select("doc_id", "base", spans.alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind and checksum of the base spans, and all spans as text."""
    kinds = F.col("base.kind")
    counts = [F.size(F.array_remove(F.transform(kinds, lambda x: x == F.lit(k)), False)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in angle brackets; overlapping spans are replaced as one, by the first's kind."""
    out, at = [], 0
    for a, kind, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", take: float = TAKE) -> DataFrame:
    """df with every span of its text masked; null texts stay null."""
    found = spill(occurrences(df, id_col, text_col), "occurrences")
    added = spill(added_spans(found, take).withColumnRenamed("row", "__row").withColumnRenamed("added", "__added"), "added-spans")
    joined = df.withColumn("__row", row_key(id_col, text_col)).join(added, "__row", "left").drop("__row")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            out = []
            for text, more in zip(batch.column(text_col).to_pylist(), batch.column("__added").to_pylist(), strict=True):
                spans = base_spans(text or "") + [(s["start"], s["kind"], s["end"]) for s in more or ()]
                out.append(masked(text, spans) if spans else text)
            texts = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == text_col else batch.column(c) for c in names], names=names)

    return joined.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes))
