"""Many error rules: an inverted index of the literals that patterns require, verified by the patterns.

From each pattern a set of literals is derived of which every match holds at least one. Each literal gives
one of its grams to an index. The distinct texts' grams are joined with the index, and only the pairs found
are tested by ``rlike``; the lowest rule that matches wins. Patterns of which no literal of GRAMS[-1]
characters can be said to be required are tested on every distinct text; more than MOST_OPEN of them are an error. So the result is that of testing
every rule on every text, without doing so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as k
from re import _parser as parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlake.storage import new_path

#: Lengths of grams: a literal is indexed by the first that it reaches.
GRAMS = (8, 5, 3)
#: An index of at most so many grams is broadcast; patterns without a known literal: the most, and those of one expression.
BROADCAST_GRAMS, MOST_OPEN, TOGETHER = 500_000, 2000, 100
#: Escapes that mean the same in both regex dialects; patterns with others, or with flags, are tested on every text.
SAME = re.compile(r"(?:[^\\]|\\[wWdDsSbB.|()\[\]{}+*?^$/\-tnr\\])*", re.DOTALL)

#: Character classes that the dialects read differently: a class in a class, an intersection, a leading bracket.
ODD_CLASS = re.compile(r"\[[^\]]*(?:\[|&&)|\[\^?\]")


def _parts(tokens) -> Iterator[list[set[str]]]:
    """For each part of a sequence that must match: alternatives, any one of which is in the text."""
    run = ""
    for op, value in tokens:
        if op is k.LITERAL:
            run += chr(value)
            continue
        if op is k.SUBPATTERN and not (value[1] or value[2]):
            inner = list(value[3])
            if all(x is k.LITERAL for x, _ in inner):
                run += "".join(chr(c) for _, c in inner)
                continue
        if run:
            yield {run}
            run = ""
        if op is k.SUBPATTERN and not (value[1] or value[2]):
            yield from _parts(value[3])
        elif op in (k.MAX_REPEAT, k.MIN_REPEAT, k.POSSESSIVE_REPEAT) and value[0] >= 1:
            yield from _parts(value[2])
        elif op is k.ATOMIC_GROUP:
            yield from _parts(value)
        elif op is k.BRANCH:
            each = [_best(branch) for branch in value[1]]
            if all(each):
                yield set().union(*each)
    if run:
        yield {run}


def _best(tokens) -> set[str] | None:
    """The part whose shortest alternative is longest."""
    return max(_parts(tokens), key=lambda x: (min(map(len, x)), -len(x)), default=None)


def required_literals(pattern: str) -> list[str] | None:
    """Literals of which every match holds one, each at least GRAMS[-1] long; None if that can't be said.

    Case counts; patterns that set flags, or use escapes that the two dialects read differently, give None.
    """
    if not SAME.fullmatch(pattern) or "(?" in pattern.replace("(?:", "") or ODD_CLASS.search(pattern):
        return None
    try:
        tokens = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    found = _best(tokens)
    return sorted(found) if found and min(map(len, found)) >= GRAMS[-1] and all(ord(c) < 0x10000 for x in found for c in x) else None


def gram_index(rules: DataFrame) -> DataFrame:
    """rule_id, error_pattern, size and gram: one row for each required literal; a null gram where none is known."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rule, pattern in zip(batch["rule_id"], batch["error_pattern"]):
                for literal in required_literals(pattern) or [None]:
                    size = next((g for g in GRAMS if literal and len(literal) >= g), 0)
                    # the middle of a literal is rarer than its beginning, which many rules share
                    start = (len(literal) - size) // 2 if size else 0
                    out.append((rule, pattern, size, literal[start : start + size] if size else None))
            yield pd.DataFrame(out, columns=["rule_id", "error_pattern", "size", "gram"])

    named = rules.where("error_pattern is not null and rule_id is not null").select(F.col("rule_id").cast("long"), "error_pattern")
    return named.repartition("rule_id").mapInPandas(parse, "rule_id long, error_pattern string, size int, gram string").dropDuplicates(["rule_id", "error_pattern", "gram"])


def _grams_of(text: str, size: int) -> Column:
    """Every run of so many characters; of a shorter text, itself."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - (size - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))


def matched(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """text and rule_id: the lowest rule found in each of the distinct ``texts`` (text); texts without one are left out.

    ``rules`` has rule_id and error_pattern. Broadcasts are counted first: the grams of those lengths that
    are few enough together; the others are joined by shuffle.
    """
    path = new_path(texts.sparkSession, "rule-index")
    gram_index(rules).write.parquet(path)
    index = texts.sparkSession.read.parquet(path)
    listed, open_ = index.where("gram is not null").select("rule_id", "error_pattern", "gram", "size"), index.where("gram is null")
    rest = [(r["rule_id"], r["error_pattern"]) for r in open_.orderBy("rule_id", "error_pattern").limit(MOST_OPEN + 1).collect()]
    if len(rest) > MOST_OPEN:
        raise ValueError(f"more than {MOST_OPEN} patterns require no literal of {GRAMS[-1]} characters")
    path = new_path(texts.sparkSession, "rule-texts")
    texts.select("text", F.xxhash64("text").alias("at")).write.parquet(path)
    texts = texts.sparkSession.read.parquet(path)
    out = texts.select("text", F.lit(None).cast("long").alias("rule_id")).where(F.lit(False))
    counts = {r["size"]: r["n"] for r in listed.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most GRAMS
    few, held = [], 0
    for size, n in sorted(counts.items(), key=lambda x: x[1]):
        held += n
        if held <= BROADCAST_GRAMS:
            few.append(size)
    for sizes, hint in ((few, F.broadcast), (sorted(counts.keys() - set(few)), lambda df: df)):
        if sizes:
            # numbers stand for texts and grams in the join, so that no text travels once for each of its grams; what
            # numbers that collide add is a pair more, which the pattern refuses
            grams = F.array_distinct(F.flatten(F.array(*[F.transform(_grams_of("text", g), lambda x: F.xxhash64(x)) for g in sizes])))
            each = texts.select("at", F.explode(grams).alias("gram"))
            own = listed.where(F.col("size").isin(sizes)).select("rule_id", "error_pattern", F.xxhash64("gram").alias("gram"))
            pairs = each.join(hint(own), "gram").select("at", "rule_id", "error_pattern").join(texts, "at")
            out = out.unionByName(pairs.where(F.rlike("text", F.col("error_pattern"))).select("text", "rule_id"))
    if rest:
        some = [rest[at : at + TOGETHER] for at in range(0, len(rest), TOGETHER)]
        none = F.lit(None).cast("long")
        firsts = [F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(i).cast("long")) for i, p in part], none) for part in some]
        out = out.unionByName(texts.select("text", F.least(none, *firsts).alias("rule_id")).where("rule_id is not null"))
    return out.groupBy("text").agg(F.min("rule_id").alias("rule_id"))


def classify_by_table(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule_id, error_category, is_auto_fixable, confidence_score as ``classify.classify`` does, by a table of any number of rules.

    ``rules`` has rule_id (unique), error_pattern, category and is_auto_fixable. Rules without an id or a
    pattern are no rules. Equal texts are tested once; a text that most runs share joins as one row.
    """
    text = F.concat_ws(" ", F.coalesce("error_message", F.lit("")), F.coalesce("error_code", F.lit("")))
    with_text = runs.withColumn("_text", text)
    first = matched(with_text.select(F.col("_text").alias("text")).distinct(), rules)
    facts = rules.select(F.col("rule_id").cast("long"), F.col("category").alias("error_category"), "is_auto_fixable")
    decided = first.join(facts, "rule_id").select(F.col("text").alias("_text"), "rule_id", "error_category", "is_auto_fixable")
    out = with_text.join(decided, "_text", "left").drop("_text")
    known = F.col("rule_id").isNotNull()
    return out.withColumns({"error_category": F.coalesce("error_category", F.lit("unknown")), "is_auto_fixable": F.coalesce("is_auto_fixable", F.lit(False)), "confidence_score": F.when(known, 1.0).otherwise(0.0)})
