"""Search stages: text clauses with scores, facets, highlights, exact vector search, and classic `$text`.

Texts are folded (decomposed, marks removed, lower case); ASCII texts, where that is lower case alone, take a short way.
Words, phrases and beginnings of words are counted by patterns over the folded text, which find whole tokens without making
any; clauses that look at tokens themselves (slop, fuzzy and sequential completion, analysed fields) get arrays of them, and
only in texts that hold the query's words at all where that is necessary. Everything runs on the JVM. Ranking is a sort on
the negated score and the id's text, so a following `$limit` is a bounded top-k; what is sorted has been exchanged before, so
that the sort's sample does not search a second time.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, UnsupportedOperator
from ..functions.core import E, Scope, hidden, is_array, is_date, is_null, is_number, is_string, literal, quote, rank, resolve
from ..functions.strings import glob_regex, java_regex
from .filters import compile_filter

WORD = r"(?U)\w+"
_WORD = re.compile(r"\w+")
OPERATORS = ("text", "phrase", "autocomplete", "wildcard", "regex", "exists", "in", "equals", "range", "near", "compound")


def plain_tokens(text: str, case_sensitive: bool = False, diacritic_sensitive: bool = False) -> list[str]:
    """Tokens of a query."""
    import unicodedata

    if not diacritic_sensitive:
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _WORD.findall(text if case_sensitive else text.lower())


def folded(text: Column, case_sensitive: bool = False, diacritic_sensitive: bool = False) -> Column:
    plain = text
    if not diacritic_sensitive:
        ascii_only = F.octet_length(text) == F.char_length(text)
        text = F.when(ascii_only, text).otherwise(F.regexp_replace(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), plain, F.lit(True)), r"\p{M}+", ""))
    return text if case_sensitive else F.lower(text)


#: Keeps the texts of an array apart in one string: no word character, and no part of a phrase.
APART = "\u0001"


def word_pattern(word: str) -> str:
    """Matches a whole token: the literal first, so that texts are searched for it before anything else is looked at."""
    return rf"(?U){_literal(word)}(?!\w)(?<!\w{_literal(word)})"


def prefix_pattern(word: str) -> str:
    return rf"(?U){_literal(word)}(?<!\w{_literal(word)})"


def phrase_pattern(words: list[str]) -> str:
    """Matches the first token of a phrase where the others follow, each start on its own."""
    rest = "".join(rf"[^\w{APART}]+{_literal(w)}(?!\w)" for w in words[1:])
    return word_pattern(words[0]) + (rf"(?={rest})" if rest else "")


def _literal(word: str) -> str:
    return re.sub(r"([^\w])", r"\\\1", word)


def count_of(folded_text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(folded_text, F.lit(pattern)), F.lit(0))


def tokens_of(folded_text: Column) -> Column:
    return F.regexp_extract_all(folded_text, F.lit(WORD), F.lit(0))


def texts_of(e: E) -> Column | None:
    """A text column or an array of texts as an array, None for other columns."""
    if is_string(e.type):
        return F.when(e.col.isNotNull(), F.array(e.col)).otherwise(F.array().cast("array<string>"))
    if is_array(e.type) and is_string(e.type.elementType):
        return F.coalesce(F.filter(e.col, lambda x: x.isNotNull()), F.array().cast("array<string>"))
    return None


@dataclass
class Index:
    """A search index: the paths it holds texts of (None: all)."""

    fields: dict[str, dict] | None = None

    @staticmethod
    def of(definition: dict | None) -> Index:
        mappings = (definition or {}).get("mappings", {})
        if mappings.get("dynamic") or not mappings.get("fields"):
            return Index(None)
        return Index({p: (f if isinstance(f, dict) else f[0]) for p, f in mappings["fields"].items()})

    def text_paths(self, schema: T.StructType) -> list[str]:
        if self.fields is not None:
            return [p for p, f in self.fields.items() if f.get("type", "string") in ("string", "autocomplete", "token")]
        return [f.name for f in schema.fields if not hidden(f.name) and texts_of(E(F.col(quote(f.name)), f.dataType)) is not None]


@dataclass
class Compiler:
    df: DataFrame
    index: Index
    scope: Scope
    columns: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    whole: dict[str, str] = field(default_factory=dict)

    def paths(self, spec: Any) -> list[str]:
        if spec is None or spec == {"wildcard": "*"}:
            return self.index.text_paths(self.df.schema)
        return [spec] if isinstance(spec, str) else list(spec)

    def materialise(self, path: str) -> tuple[Column, Column, Column] | None:
        """(texts, folded texts, tokens) of a path as hidden columns."""
        if path not in self.columns:
            texts = texts_of(resolve(self.scope, path))
            if texts is None:
                return None
            k = len(self.columns)
            names = (f"__sd_x{k}", f"__sd_y{k}", f"__sd_z{k}")
            own = self.text(path)
            self.df = self.df.withColumn(names[0], texts)
            self.df = self.df.withColumn(names[1], F.when(F.size(names[0]) > 0, F.split(own, APART)).otherwise(F.array().cast("array<string>")))
            self.df = self.df.withColumn(names[2], F.transform(names[1], tokens_of))
            self.columns[path] = names
        return tuple(F.col(n) for n in self.columns[path])

    def text(self, path: str) -> Column | None:
        """All texts of a path, folded, as one hidden string column. A text is folded on its own: marks and case do not
        depend on its neighbours."""
        if path not in self.whole:
            e = resolve(self.scope, path)
            texts = texts_of(e)
            if texts is None:
                return None
            self.whole[path] = f"__sd_w{len(self.whole)}"
            self.df = self.df.withColumn(self.whole[path], folded(e.col if is_string(e.type) else F.array_join(texts, APART)))
        return F.col(self.whole[path])

    def counts(self, spec: Any, patterns: dict[str, float]) -> Column:
        """Sum over paths of how often patterns match, each by its weight."""
        found = [t for t in map(self.text, self.paths(spec)) if t is not None]
        parts = [count_of(t, p) * F.lit(float(w)) for t in found for p, w in patterns.items()]
        return reduce(lambda a, b: a + b, parts, F.lit(0.0))

    def each(self, spec: Any, score: Any) -> Column:
        """Sum over paths of a score of (texts, folded texts, token lists)."""
        parts = [score(*m) for m in map(self.materialise, self.paths(spec)) if m is not None]
        return reduce(lambda a, b: a + b, parts, F.lit(0.0))


@dataclass
class Clause:
    matched: Column
    score: Column
    distance: Column | None = None


def _terms(spec: dict) -> list[str]:
    query = spec.get("query")
    terms = [t for q in (query if isinstance(query, list) else [query]) for t in plain_tokens(str(q))]
    if not isinstance(query, str | list) or not terms:
        raise QueryError("a search clause needs a query with words")
    return terms


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _text(spec: dict, c: Compiler) -> Clause:
    terms = _terms(spec)
    # each occurrence of a token counts as often as the query has the term
    score = c.counts(spec.get("path"), {word_pattern(t): terms.count(t) for t in terms})
    return Clause(score > 0, score)


def _phrase_score(tokens: Column, terms: list[str], slop: int) -> Column:
    """Each start of the phrase counts 1 / (1 + words in between)."""
    at = F.sequence(F.lit(0), F.size(tokens) - 1)
    if slop == 0:
        hit = lambda k: reduce(lambda a, b: a & b, [F.get(tokens, k + i) == t for i, t in enumerate(terms)])
        found = F.size(F.filter(at, lambda k: F.coalesce(hit(k), F.lit(False)))).cast("double")
    else:

        def start(k: Column) -> Column:
            place = k
            for t in terms[1:]:
                room = F.slice(tokens, place + 2, F.lit(slop + 1))
                here = F.array_position(room, F.lit(t))
                place = F.when(place.isNotNull() & (here > 0), place + here.cast("int"))
            return F.when((F.get(tokens, k) == terms[0]) & place.isNotNull(), 1.0 / (1.0 + (place - k - (len(terms) - 1)))).otherwise(0.0)

        found = total(F.transform(at, start))
    return F.when(F.size(tokens) >= len(terms), found).otherwise(0.0)


def _phrase(spec: dict, c: Compiler) -> Clause:
    terms, slop = _terms(spec), spec.get("slop", 0)
    if slop == 0:
        score = c.counts(spec.get("path"), {phrase_pattern(terms): 1})
        return Clause(score > 0, score)
    there = reduce(lambda a, b: a & b, [c.counts(spec.get("path"), {word_pattern(t): 1}) > 0 for t in terms])
    score = c.each(spec.get("path"), lambda _, __, lists: total(F.transform(lists, lambda tokens: _phrase_score(tokens, terms, slop))))
    score = F.when(there, score).otherwise(0.0)
    return Clause(there & (score > 0), score)


def _autocomplete(spec: dict, c: Compiler) -> Clause:
    terms, fuzzy = _terms(spec), spec.get("fuzzy") or {}
    order, mode = spec.get("tokenOrder", "any"), spec.get("scoreMode", "frequency")
    if order not in ("any", "sequential") or mode not in ("frequency", "binary"):
        raise QueryError("autocomplete takes tokenOrder any or sequential and scoreMode frequency or binary")
    if spec.get("fuzzy") is None and order == "any":
        parts = []
        for text in (t for t in map(c.text, c.paths(spec.get("path"))) if t is not None):
            hits_of = [count_of(text, prefix_pattern(w)) for w in terms]
            summed = reduce(lambda a, b: a + b, hits_of).cast("double") if mode == "frequency" else F.lit(float(len(terms)))
            parts.append(F.when(reduce(lambda a, b: a & b, [h > 0 for h in hits_of]), summed).otherwise(0.0))
        best = F.greatest(*parts) if len(parts) > 1 else parts[0] if parts else F.lit(0.0)
        return Clause(best > 0, best)
    edits, prefix, most = (fuzzy.get("maxEdits", 2) if spec.get("fuzzy") is not None else 0), fuzzy.get("prefixLength", 0), fuzzy.get("maxExpansions", 50)

    def hit(token: Column, term: str) -> Column:
        plain = token.startswith(term)
        if not edits:
            return plain
        close = lambda other: F.levenshtein(F.lit(term), other, edits) >= 0
        near = close(token) | close(F.substring(token, 1, max(len(term), prefix)))
        if prefix:
            near = near & (F.char_length(token) >= prefix) & (F.substring(token, 1, prefix) == term[:prefix]) if len(term) >= prefix else F.lit(False)
        return plain | near

    def hits(kinds: Column, word: str) -> Column:
        return F.filter(kinds, lambda t: hit(t, word))

    def first_of(tokens: Column, wanted: Column) -> Column:
        return F.array_min(F.transform(tokens, lambda t, k: F.when(F.array_contains(wanted, t), k)))

    def members(tokens: Column, wanted: Column) -> Column:
        return F.size(F.filter(tokens, lambda t: F.array_contains(wanted, t))).cast("double")

    def score(_: Column, __: Column, lists: Column) -> Column:
        every = F.flatten(lists)
        kinds = F.array_distinct(every)
        found = [hits(kinds, w) for w in terms]
        found = [F.slice(f, 1, most) for f in found] if edits else found
        if order == "sequential":
            at: Column = F.lit(0)
            for f in found:
                rest = F.slice(kinds, at + 1, F.greatest(F.size(kinds) - at, F.lit(0)))
                place = first_of(rest, f)
                at = F.when(at.isNotNull() & place.isNotNull(), at + place + 1)
            return F.when(at.isNotNull() & (F.size(kinds) > 0), F.lit(float(len(terms)) if mode == "frequency" else 1.0)).otherwise(0.0)
        local = [members(every, f) if mode == "frequency" else F.lit(1.0) for f in found]
        all_there = reduce(lambda a, b: a & b, [F.size(f) > 0 for f in found])
        return F.when(all_there, reduce(lambda a, b: a + b, local)).otherwise(0.0)

    parts = [score(*m) for m in map(c.materialise, c.paths(spec.get("path"))) if m is not None]
    best = F.greatest(*parts) if len(parts) > 1 else parts[0] if parts else F.lit(0.0)
    return Clause(best > 0, best)


def _wildcard(spec: dict, c: Compiler) -> Clause:
    glob = glob_regex(str(spec["query"]).lower())
    tokens_too = bool(spec.get("allowAnalyzedField"))
    test = lambda value, tokens: value.rlike(glob) | (F.exists(tokens, lambda t: t.rlike(glob)) if tokens_too else F.lit(False))
    score = c.each(spec.get("path"), lambda texts, _, lists: total(F.zip_with(texts, lists, lambda v, t: test(F.lower(v), t).cast("double"))))
    return Clause(score > 0, score)


def _regex(spec: dict, c: Compiler) -> Clause:
    pattern = java_regex(str(spec["query"]), "".join(f for f in str(spec.get("flags") or spec.get("options") or "") if f in "imsx"))
    tokens_too = bool(spec.get("allowAnalyzedField"))
    test = lambda value: value.rlike(pattern) | (F.exists(F.regexp_extract_all(value, F.lit(WORD), F.lit(0)), lambda t: t.rlike(pattern)) if tokens_too else F.lit(False))
    score = c.each(spec.get("path"), lambda texts, _, __: total(F.transform(texts, lambda v: test(v).cast("double"))))
    return Clause(score > 0, score)


def _exists(spec: dict, c: Compiler) -> Clause:
    paths = c.paths(spec["path"]) if spec.get("path") is not None else list(c.index.fields or c.index.text_paths(c.df.schema))
    parts = [resolve(c.scope, p) for p in paths]
    score = reduce(lambda a, b: a + b, [(F.lit(0.0) if is_null(e.type) else e.col.isNotNull().cast("double")) for e in parts], F.lit(0.0))
    return Clause(score > 0, score)


def _scalars(c: Compiler, path: str) -> E:
    """The scalar values at a path as an array."""
    e = resolve(c.scope, path)
    if is_array(e.type):
        return e
    return E(F.when(e.col.isNotNull(), F.array(e.col)), T.ArrayType(e.type))


def _counted(e: E, test: Any) -> Clause:
    score = F.coalesce(F.size(F.filter(e.col, lambda x: F.coalesce(test(E(x, e.type.elementType)), F.lit(False)))), F.lit(0)).cast("double")
    score = F.greatest(score, F.lit(0.0))
    return Clause(score > 0, score)


def _same(x: E, wanted: Any) -> Column:
    target = literal(wanted)
    return x.col == target.col if rank(x.type) == rank(target.type) else F.lit(False)


def _in(spec: dict, c: Compiler) -> Clause:
    wanted = spec["value"] if isinstance(spec["value"], list) else [spec["value"]]
    return _counted(_scalars(c, spec["path"]), lambda x: reduce(lambda a, b: a | b, [_same(x, w) for w in wanted], F.lit(False)))


def _equals(spec: dict, c: Compiler) -> Clause:
    return _counted(_scalars(c, spec["path"]), lambda x: _same(x, spec["value"]))


def _range(spec: dict, c: Compiler) -> Clause:
    bounds = {k: v for k, v in spec.items() if k in ("gt", "gte", "lt", "lte")}
    if not bounds or len({isinstance(v, datetime.date) for v in bounds.values()}) > 1:
        raise QueryError("range takes bounds of one family")
    how = {"gt": lambda x, b: x > b, "gte": lambda x, b: x >= b, "lt": lambda x, b: x < b, "lte": lambda x, b: x <= b}

    def test(x: E) -> Column:
        targets = {k: literal(v) for k, v in bounds.items()}
        if any(rank(t.type) != rank(x.type) for t in targets.values()):
            return F.lit(False)
        return reduce(lambda a, b: a & b, [how[k](x.col, t.col) for k, t in targets.items()])

    return _counted(_scalars(c, spec["path"]), test)


def _near(spec: dict, c: Compiler) -> Clause:
    e, pivot = resolve(c.scope, spec["path"]), float(spec["pivot"])
    origin = literal(spec["origin"])
    if is_date(e.type) and is_date(origin.type):
        distance = F.abs(F.unix_micros(e.col.cast("timestamp")) - F.unix_micros(origin.col.cast("timestamp"))) / 1e6
    elif is_number(e.type) and is_number(origin.type):
        distance = F.abs(e.col.cast("double") - origin.col.cast("double"))
    else:
        return Clause(F.lit(False), F.lit(0.0), F.lit(None).cast("double"))
    matched = F.coalesce(distance <= pivot, F.lit(False))
    return Clause(matched, F.when(matched, 1 + 1 / (1 + distance / pivot)).otherwise(0.0), F.when(matched, distance))


def _compound(spec: dict, c: Compiler) -> Clause:
    parts = {k: [clause(x, c) for x in (v if isinstance(v, list) else [v])] for k, v in spec.items() if k in ("must", "should", "filter", "mustNot")}
    if not parts:
        raise QueryError("compound takes must, should, filter or mustNot")
    should = parts.get("should", [])
    least = spec.get("minimumShouldMatch", 1 if should and len(parts) == 1 else 0)
    matched = reduce(lambda a, b: a & b, [x.matched for k in ("must", "filter") for x in parts.get(k, [])] + [~x.matched for x in parts.get("mustNot", [])], F.lit(True))
    count = reduce(lambda a, b: a + b, [x.matched.cast("int") for x in should], F.lit(0))
    score = reduce(lambda a, b: a + b, [F.when(x.matched, x.score).otherwise(0.0) for x in should], F.lit(0.0))
    matched = matched & (count >= least) if should else matched
    near = [x.distance for x in should if x.distance is not None]
    distance = (F.least(*near) if len(near) > 1 else near[0]) if near else None
    return Clause(matched, F.when(matched, 1.0 + score + count.cast("double")).otherwise(0.0), distance)


_CLAUSES = {"text": _text, "phrase": _phrase, "autocomplete": _autocomplete, "wildcard": _wildcard, "regex": _regex, "exists": _exists, "in": _in, "equals": _equals, "range": _range, "near": _near, "compound": _compound}


def clause(spec: Any, c: Compiler) -> Clause:
    names = [k for k in spec if k in _CLAUSES]
    if len(names) != 1:
        raise UnsupportedOperator("search operator", ", ".join(k for k in spec if k not in ("index", "score")) or "none")
    return _CLAUSES[names[0]](spec[names[0]], c)


def _id_text(df: DataFrame) -> Column:
    """What ties go by: the id's text, or, without an id, a hash of the document, so that ranks do not depend on partitions."""
    if "_id" in df.columns:
        return F.col("_id").cast("string")
    shown = [F.col(quote(f.name)) for f in df.schema.fields if not hidden(f.name)]
    return F.lpad(F.hex(F.xxhash64(F.to_json(F.struct(*shown)))), 16, "0")


def search(df: DataFrame, spec: dict, definition: dict | None = None) -> DataFrame:
    """`$search`: matching documents, best first, with their score (and highlights) as metadata."""
    options = {k: spec[k] for k in ("index", "count", "highlight", "facet", "returnStoredSource") if k in spec}
    c = Compiler(df, Index.of(definition), Scope.of(df.schema))
    body = {k: v for k, v in spec.items() if k not in options}
    found = clause(body, c)
    shown = _highlights(c, options["highlight"], body) if "highlight" in options else None
    made = c.df.withColumn("__sd_m", found.matched).withColumn("__meta_searchScore", found.score).withColumn("__sd_d", found.distance if found.distance is not None else F.lit(None).cast("double"))
    made = made.where("__sd_m")
    order = [F.col("__sd_d")] if "near" in body else [-F.col("__meta_searchScore"), F.coalesce("__sd_d", F.lit(float("inf")))]
    made = made.withColumns({f"__sd_rank{i}": k for i, k in enumerate([*order, _id_text(made)])})
    if shown is not None:
        made = made.withColumn("__meta_searchHighlights", shown)
    ranks = [n for n in made.columns if n.startswith("__sd_rank")]
    gone = [*(n for names in c.columns.values() for n in names), *c.whole.values()]
    made = made.drop("__sd_m", "__sd_d", *gone)
    # the sort's sample reads the exchange, not the search; a hash of the ranks spreads rows alike in every attempt
    return made.repartition(int(made.sparkSession.conf.get("spark.sql.shuffle.partitions")), *ranks).orderBy(*ranks)


def _query_words(spec: Any) -> list[str]:
    if isinstance(spec, dict):
        if isinstance(spec.get("query"), str | list):
            return _terms(spec)
        return [w for v in spec.values() for w in _query_words(v)]
    return [w for v in spec for w in _query_words(v)] if isinstance(spec, list) else []


def _highlights(c: Compiler, spec: dict, body: dict) -> Column:
    """Passages around the first hit of each text: path, passage, and the hits' places in it (in code points)."""
    words, most, passages = frozenset(_query_words(body)), int(spec.get("maxChars", 120)), spec.get("maxNumPassages")
    if passages is not None and (not isinstance(passages, int) or isinstance(passages, bool) or passages <= 0):
        raise QueryError("maxNumPassages is a positive whole number")
    kind = "array<struct<path:string,text:string,hits:array<struct<start:int,end:int>>>>"
    names = c.paths(spec.get("path"))
    columns = [m[0] for m in map(c.materialise, names) if m is not None]
    shown = [n for n in names if c.materialise(n) is not None]

    @F.pandas_udf(kind)
    def passages_of(texts_by_path: pd.DataFrame) -> pd.Series:
        out = []
        for row in texts_by_path.itertuples(index=False):
            found = []
            for name, texts in zip(shown, row, strict=True):
                for text in texts:
                    hits = [m.span() for m in _WORD.finditer(text) if plain_tokens(m[0]) and plain_tokens(m[0])[0] in words]
                    if hits and (passages is None or len(found) < passages):
                        lo = max(0, min(hits[0][0], len(text) - most))
                        found.append({"path": name, "text": text[lo : lo + most], "hits": [{"start": a - lo, "end": b - lo} for a, b in hits if b <= lo + most]})
            out.append(found)
        return pd.Series(out)

    return passages_of(F.struct(*columns))


def search_meta(df: DataFrame, spec: dict, definition: dict | None = None) -> DataFrame:
    """`$searchMeta`: one row with the count and the facets' buckets."""
    facet, counted = spec.get("facet"), spec.get("count")
    body = {k: v for k, v in spec.items() if k not in ("index", "count", "facet", "highlight")}
    if facet and "operator" in facet:
        body = facet["operator"]
    if not facet and counted is None:
        raise QueryError("$searchMeta takes count or facet")
    c = Compiler(df, Index.of(definition), Scope.of(df.schema))
    found = clause(body, c) if body else Clause(F.lit(True), F.lit(1.0))
    matched = c.df.withColumn("__sd_m", found.matched).where("__sd_m")
    out = matched.sparkSession.range(1) if counted is None else _count(matched, counted)
    if facet:
        facets = []
        for name, how in (facet.get("facets") or {"facet": facet}).items():
            e = _scalars(Compiler(matched, c.index, Scope.of(matched.schema)), how["path"])
            values = matched.select(F.explode(F.array_distinct(F.filter(e.col, lambda x: x.isNotNull()))).alias("_id"))
            if how.get("boundaries"):
                b = how["boundaries"]
                chain = F
                for lo, hi in zip(b, b[1:], strict=False):
                    chain = chain.when((F.col("_id") >= literal(lo).col) & (F.col("_id") < literal(hi).col), literal(lo).col)
                values = values.select(chain.otherwise(F.lit(None)).alias("_id")).where("_id is not null")
            buckets = values.groupBy("_id").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "_id").limit(int(how.get("numBuckets", 10)))
            listed = buckets.agg(F.array_sort(F.collect_list(F.struct("count", "_id")), lambda a, b_: F.when(a["count"] > b_["count"], -1).when(a["count"] < b_["count"], 1).when(a["_id"] < b_["_id"], -1).when(a["_id"] > b_["_id"], 1).otherwise(0)).alias("l"))
            facets.append((name, listed.select(F.struct(F.transform("l", lambda x: F.struct(x["_id"].alias("_id"), x["count"].alias("count"))).alias("buckets")).alias(name))))
        for _, row in facets:
            out = out.join(F.broadcast(row), how="cross")  # one row each
        out = out.select(*([] if counted is None else ["count"]), F.struct(*[F.col(quote(n)) for n, _ in facets]).alias("facet"))
    return out


def _count(matched: DataFrame, spec: dict) -> DataFrame:
    """One row: all matches are counted; only a threshold that the caller gives caps the number, and the row says so."""
    if not isinstance(spec, dict) or set(spec) - {"type", "threshold"} or spec.get("type", "total") not in ("total", "lowerBound"):
        raise QueryError("count takes type (total or lowerBound) and threshold")
    kind, most = spec.get("type", "total"), spec.get("threshold")
    if most is None:
        return matched.agg(F.struct(F.count(F.lit(1)).alias(kind), F.lit(True).alias("exact")).alias("count"))
    if kind != "lowerBound" or not isinstance(most, int) or isinstance(most, bool) or most <= 0:
        raise QueryError("threshold is a positive whole number for lowerBound")
    n, limit = F.count(F.lit(1)), F.lit(most).cast("long")
    return matched.agg(F.struct(F.least(n, limit).alias(kind), (n <= limit).alias("exact"), limit.alias("threshold"), (n > limit).alias("cappedByThreshold")).alias("count"))


# --- vectors ---------------------------------------------------------------------------------------------------------


def similarity(vector: Column, query: list[float], kind: str) -> Column:
    """Score of an array<double> column against a fixed vector, in double precision; null where it is undefined."""
    fixed = F.array(*[F.lit(float(x)) for x in query])
    fold = lambda pairs: F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)
    dot = fold(F.zip_with(vector, fixed, lambda a, b: a * b))
    if kind == "dotProduct":
        return dot
    if kind == "euclidean":
        return -F.sqrt(fold(F.zip_with(vector, fixed, lambda a, b: (a - b) * (a - b))))
    if kind == "cosine":
        norm = F.sqrt(fold(F.transform(vector, lambda a: a * a)))
        own = sum(x * x for x in query) ** 0.5
        return F.when((norm > 0) & F.lit(own > 0), dot / (norm * F.lit(own or 1.0)))
    raise QueryError(f"unknown similarity {kind}")


def vector_search(df: DataFrame, spec: dict, definition: dict | None = None) -> DataFrame:
    """`$vectorSearch`: the filter first, then the exact `limit` best by score, ties by id; a plan of one scan with a
    bounded top-k, whatever numCandidates says."""
    query, n = spec.get("queryVector"), spec.get("limit")
    if not isinstance(query, list) or not query or not isinstance(n, int) or n < 1 or spec.get("numCandidates", n) < n:
        raise QueryError("$vectorSearch takes a queryVector, a positive limit and numCandidates of at least that")
    fields = (definition or {}).get("fields") or []
    how = next((f for f in fields if f.get("path") == spec["path"] and f.get("type", "vector") == "vector"), {})
    kind = how.get("similarity", spec.get("similarity", "cosine"))
    e = resolve(Scope.of(df.schema), spec["path"])
    if not is_array(e.type) or not is_number(e.type.elementType):
        raise QueryError("$vectorSearch needs an array of numbers")
    if how.get("numDimensions", len(query)) != len(query):
        raise QueryError("the query vector has another number of dimensions than the index")
    rows = df.where(compile_filter(spec["filter"], Scope.of(df.schema))) if spec.get("filter") else df
    vector = e.col.cast("array<double>")
    scored = rows.where(F.size(e.col) == len(query)).withColumn("__meta_vectorSearchScore", similarity(vector, query, kind)).where(F.col("__meta_vectorSearchScore").isNotNull())
    if spec.get("minScore") is not None:
        scored = scored.where(F.col("__meta_vectorSearchScore") >= float(spec["minScore"]))
    key = F.col("_id") if "_id" in df.columns else F.monotonically_increasing_id()
    ranked = scored.withColumns({"__sd_rank0": -F.col("__meta_vectorSearchScore"), "__sd_rank1": key})
    return ranked.orderBy("__sd_rank0", "__sd_rank1").limit(n)


# --- classic $text ---------------------------------------------------------------------------------------------------

_CHUNK = re.compile(r'-?"[^"]*"|\S+')


def classic_text(df: DataFrame, spec: Any, paths: tuple[str, ...], weights: dict[str, float] | None = None) -> DataFrame:
    """Documents that hold one of the terms (and every quoted phrase, and nothing negated), with `textScore`: the sum
    over fields of weight times occurrences of the terms."""
    if not isinstance(spec, dict) or not isinstance(spec.get("$search"), str):
        raise QueryError("$text takes $search")
    if not paths:
        raise QueryError("$text needs a text index")
    case, marks = bool(spec.get("$caseSensitive")), bool(spec.get("$diacriticSensitive"))
    terms: list[str] = []
    without: list[str] = []
    phrases: list[tuple[bool, list[str]]] = []
    for chunk in _CHUNK.findall(spec["$search"]):
        negative, body = chunk.startswith("-"), chunk.lstrip("-") if chunk.startswith("-") else chunk
        words = plain_tokens(body.strip('"'), case, marks)
        if body.startswith('"') and words:
            phrases.append((negative, words))
            terms += [] if negative else words
        else:
            (without if negative else terms).extend(words)
    scope = Scope.of(df.schema)
    score: Column = F.lit(0.0)
    texts = []
    for k, path in enumerate(paths):
        e = resolve(scope, path)
        own = texts_of(e)
        if own is None:
            continue
        df = df.withColumn(f"__sd_w{k}", folded(e.col if is_string(e.type) else F.array_join(own, APART), case, marks))
        texts.append(F.col(f"__sd_w{k}"))
        hits = reduce(lambda a, b: a + b, [count_of(texts[-1], word_pattern(w)) for w in terms], F.lit(0))
        score = score + hits * F.lit(float((weights or {}).get(path, 1)))
    anywhere = lambda pattern: reduce(lambda a, b: a | b, [F.coalesce(t.rlike(pattern), F.lit(False)) for t in texts], F.lit(False))
    test: Column = score > 0
    for word in without:
        test = test & ~anywhere(word_pattern(word))
    for negative, words in phrases:
        there = anywhere(phrase_pattern(words))
        test = test & (~there if negative else there)
    out = df.withColumn("__meta_textScore", score.cast("double")).where(F.coalesce(test, F.lit(False)))
    return out.drop(*[f"__sd_w{k}" for k in range(len(paths))])
