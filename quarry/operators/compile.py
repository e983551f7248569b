"""Query trees to Spark columns: predicates, wildcard expansion, BM25 scores.

Fields are compared on padded text: tokens joined by single spaces with one at
either end. A phrase is a substring of it; wildcards inside phrases and
proximity are regular expressions over it, with a cheap substring test first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.vocab import BM25, MAX_EXPANSIONS, TEXT_FIELDS
from quarry.operators.corpus import bucket
from quarry.plans.ast import And, Filter, Near, Node, Not, Or, Phrase, Term, Wildcard, YearRange, walk
from quarry.plans.canonical import wildcards


class TooManyExpansions(ValueError):
    code = "WILDCARD_TOO_MANY_EXPANSIONS"


class FieldNotIndexed(ValueError):
    code = "FIELD_NOT_INDEXED"


def fits(term: Column, w: Wildcard) -> Column:
    if w.op == "*":
        return F.startswith(term, F.lit(w.stem))
    return F.startswith(term, F.lit(w.stem)) & (F.char_length(term) <= len(w.stem) + 1)


def matching(vocabulary: DataFrame, asked: list[Wildcard]) -> DataFrame:
    """The rows of a vocabulary that some wildcards stand for, once for each, with the wildcard's place in the list as w."""
    tests = [F.when(fits(F.col("term"), w), F.lit(i)) for i, w in enumerate(asked)]
    some = reduce(lambda a, b: a | b, [fits(F.col("term"), w) for w in asked], F.lit(False))
    return vocabulary.where(some).select("*", F.explode(F.array_compact(F.array(*tests).cast("array<int>"))).alias("w"))


def all_expansions(vocabulary: DataFrame, tree: Node | None) -> DataFrame:
    """(wildcard, term): every term of every wildcard in a tree, however many; none reaches the driver."""
    asked = wildcards(tree)
    names = F.array(*[F.lit(w.stem + w.op) for w in asked]).cast("array<string>")
    return matching(vocabulary, asked).select(F.get(names, F.col("w")).alias("wildcard"), "term").distinct()


def expand(vocabulary: DataFrame, tree: Node | None, cap: int = MAX_EXPANSIONS) -> dict[tuple[str, str], list[str]]:
    """Terms of every wildcard in a tree, in one pass over the vocabulary; more than cap is refused whatever the tree's shape."""
    asked = wildcards(tree)
    if not asked:
        return {}
    hits = matching(vocabulary, asked).select("w", "term").distinct()
    place = F.row_number().over(_by_wildcard())
    rows = hits.withColumn("n", place).where(F.col("n") <= cap + 1).select("w", "term").collect()  # at most cap + 1 a wildcard
    found: dict[tuple[str, str], list[str]] = {(w.stem, w.op): [] for w in asked}
    for r in sorted(rows, key=lambda r: (r["w"], r["term"])):
        w = asked[r["w"]]
        found[w.stem, w.op].append(r["term"])
    for (stem, op), terms in found.items():
        if len(terms) > cap:
            raise TooManyExpansions(f"{stem}{op} stands for more than {cap} terms; use a longer stem")
    return found


def _by_wildcard():
    from pyspark.sql import Window

    return Window.partitionBy("w").orderBy("term")


def _item(i: Term | Wildcard) -> str:
    return re.escape(i.token) if isinstance(i, Term) else re.escape(i.stem) + ("[^ ]*" if i.op == "*" else "[^ ]?")


def _words(n: Term | Wildcard | Phrase) -> str:
    return " ".join(map(_item, n.items)) if isinstance(n, Phrase) else _item(n)


def _needed(n: Term | Wildcard | Phrase | Near) -> list[str]:
    """Substrings that any match must hold: the cheap test before a regular expression."""
    if isinstance(n, Near):
        return list(dict.fromkeys(_needed(n.left) + _needed(n.right)))
    items = n.items if isinstance(n, Phrase) else (n,)
    return [f" {i.token} " if isinstance(i, Term) else f" {i.stem}" for i in items]


def pattern(n: Wildcard | Phrase | Near) -> str:
    if isinstance(n, Near):
        a, b = _words(n.left), _words(n.right)
        gap = rf"(?: [^ ]+){{0,{n.distance}}} "
        return f"(?: {a}{gap}{b} )|(?: {b}{gap}{a} )"
    return f" {_words(n)} "


def _in_field(n, field: str) -> Column:
    text = F.col(f"T_{field}")
    if isinstance(n, Term):
        return F.contains(text, F.lit(f" {n.token} "))
    if isinstance(n, Wildcard) and n.op == "*":
        return F.contains(text, F.lit(f" {n.stem}"))
    if isinstance(n, Phrase) and all(isinstance(i, Term) for i in n.items):
        return F.contains(text, F.lit(" " + " ".join(i.token for i in n.items) + " "))
    first = [F.contains(text, F.lit(s)) for s in _needed(n)]
    return reduce(lambda a, b: a & b, first) & F.rlike(text, F.lit(pattern(n)))


def predicate(n: Node | None) -> Column:
    """A boolean column, never null. None is every record."""
    if n is None:
        return F.lit(True)
    if isinstance(n, And):
        return reduce(lambda a, b: a & b, map(predicate, sorted(n.children, key=_cost)))
    if isinstance(n, Or):
        return reduce(lambda a, b: a | b, map(predicate, n.children))
    if isinstance(n, Not):
        return ~predicate(n.child)
    if isinstance(n, Filter):
        col = F.col(n.field)
        plain = [v for v in n.values if not isinstance(v, YearRange)]
        tests = [col.isin(plain)] if plain else []
        tests += [col.between(v.lo, v.hi) for v in n.values if isinstance(v, YearRange)]
        return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))
    fields = [n.field] if n.field else list(TEXT_FIELDS)
    return reduce(lambda a, b: a | b, [_in_field(n, f) for f in fields])


def _cost(n: Node) -> int:
    inner = n.child if isinstance(n, Not) else n
    return 0 if isinstance(inner, Filter) else 1 if isinstance(inner, Term) else 2 if isinstance(inner, (Wildcard, Phrase)) else 3


def admit(n: Node | None, corpus: DataFrame) -> None:
    for x in walk(n) if n is not None else ():
        if isinstance(x, Filter) and x.field not in corpus.columns:
            raise FieldNotIndexed(f"the corpus has no field {x.field}")


def scored_terms(n: Node | None, expansions: dict[tuple[str, str], list[str]]) -> list[tuple[str, str | None]]:
    """(term, field) pairs of the scoring leaves, in tree order; filters and negations score nothing."""
    out: list[tuple[str, str | None]] = []

    def leaf(x, field: str | None) -> None:
        if isinstance(x, Term):
            out.append((x.token, field))
        elif isinstance(x, Wildcard):
            out.extend((t, field) for t in expansions.get((x.stem, x.op), []))
        elif isinstance(x, Phrase):
            for item in dict.fromkeys(x.items):
                leaf(item, field)
        elif isinstance(x, Near):
            for side in dict.fromkeys((x.left, x.right)):
                leaf(side, field)

    def visit(x: Node) -> None:
        if isinstance(x, (And, Or)):
            for c in x.children:
                visit(c)
        elif not isinstance(x, (Not, Filter)):
            leaf(x, x.field)

    if n is not None:
        visit(n)
    return out


def stored_length(size: Column) -> Column:
    """A field's length as search libraries store it in one byte: exact to 40, then rounded down to four significant bits above 24."""
    over = F.greatest(size - 24, F.lit(0))
    spare = F.greatest(F.length(F.bin(over)) - 4, F.lit(0))
    return F.when(size <= 40, size).otherwise(24 + (F.floor(over / F.pow(F.lit(2.0), spare)) * F.pow(F.lit(2.0), spare)).cast("int"))


def bm25(n: Node | None, expansions: dict, df: dict[tuple[str, str], int], stats: dict[str, tuple[int, float]]) -> Column:
    """The score column: field weight x BM25 of each scoring term, summed in tree order; lengths as stored in one byte."""
    k1, b = BM25["k1"], BM25["b"]
    total = F.lit(0.0)
    for term, only in scored_terms(n, expansions):
        for field in [only] if only else TEXT_FIELDS:
            held = df.get((field, term), 0)
            count, mean = stats[field]
            if not held:
                continue
            idf = F.ln(F.lit(1 + (count - held + 0.5) / (held + 0.5)))
            tokens = F.col(f"tok_{field}")
            tf = _tf(tokens, term)
            norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * stored_length(F.size(tokens)) / F.lit(mean))
            total = total + F.lit(BM25[field]) * idf * tf * F.lit(k1 + 1) / (tf + norm)
    return total


def _tf(tokens: Column, term: str) -> Column:
    return (F.size(tokens) - F.size(F.array_remove(tokens, term))).cast("double")


#: A word of a query in one field: (field, token or stem, operator, empty for a term).
Word = tuple[str, str, str]


def of_word(word: Word) -> Column:
    """Whether a row with field and term is of a word."""
    field, text, op = word
    return (F.col("field") == field) & (fits(F.col("term"), Wildcard(text, op)) if op else F.col("term") == text)


def weigh(vocabulary: DataFrame, tree: Node | None) -> dict[Word, tuple[int, frozenset[int]]]:
    """The summed document frequencies of all terms of each word, however many, and their buckets: at most two rows a word reach the driver."""
    asked = wildcards(tree)
    texts = sorted({x.token for x in walk(tree) if isinstance(x, Term)}) if tree is not None else []
    parts = [matching(vocabulary, asked), vocabulary.where(F.col("term").isin(texts)).withColumn("w", F.lit(-1))]
    rows = parts[0].unionByName(parts[1]).groupBy("field", "w", F.when(F.col("w") < 0, F.col("term")).alias("t"))
    found = rows.agg(F.sum("df").alias("n"), F.collect_set(bucket(F.col("term"))).alias("buckets")).collect()
    return {(r["field"], *((r["t"], "") if r["w"] < 0 else (asked[r["w"]].stem, asked[r["w"]].op))): (r["n"], frozenset(r["buckets"])) for r in found}


def required(n: Node | None, weight: Callable[[Iterable[Word]], int]) -> list[frozenset[Word]]:
    """Sets of words of which every match holds at least one each. Negations and filters require nothing."""

    def leaf(x, field: str | None) -> list[frozenset[Word]]:
        if isinstance(x, Near):
            return leaf(x.left, field) + leaf(x.right, field)
        fields = [field] if field else list(TEXT_FIELDS)
        words = [(i.token, "") if isinstance(i, Term) else (i.stem, i.op) for i in (x.items if isinstance(x, Phrase) else (x,))]
        return [frozenset((f, *w) for f in fields) for w in words]

    if n is None or isinstance(n, (Not, Filter)):
        return []
    if isinstance(n, And):
        return [s for c in n.children for s in required(c, weight)]
    if isinstance(n, Or):  # one of the clauses holds: the rarest set of each, together
        sides = [required(c, weight) for c in n.children]
        return [frozenset().union(*(min(s, key=weight) for s in sides))] if all(sides) else []
    return leaf(n, n.field)
