"""Chunk identifiers, weighted terms, hybrid scores, evidence bundles and the evidence graph.

Searches for the best chunks score blocks of queries in the scan of the chunks (see ``scoring``).  Where all scored pairs
are wanted, terms live in long tables, and scoring is an equality join of query terms with chunk terms and a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions.text import component_tokens, jaccard, normalize_identifier, normalize_identifiers, normalize_label, rounded, text_or_empty, tokenize
from docweave.operators.ordered import consecutive_pairs
from docweave.operators.scoring import Part, best_chunks, nearest_vectors
from docweave.scratch import Scratch
from docweave.session import spread

#: Parts of the hybrid score, and thresholds of a bundle.
SCORE = {"exact": 0.35, "tags": 0.15, "tfidf": 0.25, "lexical": 0.15, "embedding": 0.05, "prior": 0.05}
SUPPORT, CONTRADICTION = 0.45, 0.2
#: Chunks of one identifier that one task pairs with as many others.
TILE_ROWS = 1_000


def identifiers(text: Column | str, values: Column | None = None, short: int | None = 40) -> Column:
    """Distinct identifiers of a chunk: of metadata values, of the designations in its text, of a short text itself."""
    none = F.array().cast("array<string>")
    parts = [F.coalesce(values, none) if values is not None else none, component_tokens(text)]
    folded = normalize_identifiers(F.transform(F.concat(*parts), lambda x: F.regexp_replace(x, "\n", " ")) if values is not None else parts[1])
    whole = normalize_identifier(text)
    if short is not None:
        folded = F.concat(folded, F.when(F.length(whole) <= short, F.array(whole)).otherwise(none))
    return F.array_distinct(F.filter(folded, lambda x: x != ""))


def query_identifiers(text: Column | str) -> Column:
    """The identifier of a whole query, then those of the designations in it."""
    folded = F.concat(F.array(normalize_identifier(text)), F.transform(component_tokens(text), normalize_identifier))
    return F.array_distinct(F.filter(folded, lambda x: x != ""))


def grams(text: Column | str) -> Column:
    """Lower-case words of at least two characters, and pairs of neighbouring ones."""
    words = F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def term_counts(texts: DataFrame, key: str, terms: Column) -> DataFrame:
    """key, term, w: how often each term occurs."""
    return texts.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).cast("double").alias("w"))


def inverse_frequency(counts: DataFrame, texts: DataFrame) -> DataFrame:
    """term, idf: ln((1 + N) / (1 + df)) + 1 over all texts."""
    total = texts.agg(F.count(F.lit(1))).scalar()
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select(
        "term", (F.log((1 + total) / (1 + F.col("df"))) + 1).alias("idf")
    )


def cosine_scores(queries: DataFrame, chunks: DataFrame, name: str) -> DataFrame:
    """q_id, c_id and the cosine of (id, term, w) tables, for every pair with a common term.

    Lengths are one aggregate per text and are divided out at the end, so the weights themselves are never shuffled for
    them.
    """
    length = lambda df, key, to: df.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(to))
    joined = queries.select("q_id", "term", F.col("w").alias("q_w")).join(chunks.select("c_id", "term", "w"), "term")
    dots = joined.groupBy("q_id", "c_id").agg(F.sum(F.col("q_w") * F.col("w")).alias("dot"))
    full = dots.join(length(queries, "q_id", "q_n"), "q_id").join(length(chunks, "c_id", "c_n"), "c_id")
    return full.where("q_n > 0 and c_n > 0").select("q_id", "c_id", (F.col("dot") / (F.col("q_n") * F.col("c_n"))).alias(name))


def tfidf_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """q_id, c_id, tfidf: cosine of words and word pairs weighted by the chunks; terms the chunks lack drop out."""
    counts = term_counts(chunks, "c_id", grams("c_text"))
    idf = inverse_frequency(counts, chunks)
    weighted = lambda df, key: df.join(idf, "term").select(key, "term", (F.col("w") * F.col("idf")).alias("w"))
    return cosine_scores(weighted(term_counts(queries, "q_id", grams("q_text")), "q_id"), weighted(counts, "c_id"), "tfidf")


def lexical_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """q_id, c_id, lexical: cosine of plain counts of label words."""
    return cosine_scores(term_counts(queries, "q_id", tokenize("q_text")), term_counts(chunks, "c_id", tokenize("c_text")), "lexical")


def hybrid_scores(queries: DataFrame, chunks: DataFrame, prior_kind: str | None = None) -> DataFrame:
    """q_id, c_id and the parts and total of the score, for every pair that shares an identifier, tag or term.

    ``queries``: q_id, q_text.  ``chunks``: c_id, c_text, and c_kind if ``prior_kind`` is given.  Vectors are a seam: the
    embedding part is 0 without a table of them.  Parts and total have four places.
    """
    q_ids = queries.select("q_id", F.explode(query_identifiers("q_text")).alias("id"))
    c_ids = chunks.select("c_id", F.explode(identifiers("c_text")).alias("id"))
    exact = q_ids.join(c_ids, "id").select("q_id", "c_id").distinct().withColumn("exact", F.lit(1.0))
    q_tags = queries.select("q_id", F.array_distinct(F.filter(F.transform(component_tokens("q_text"), normalize_identifier), lambda x: x != "")).alias("q_tags"))
    c_tags = chunks.select("c_id", F.array_distinct(F.filter(F.transform(component_tokens("c_text"), normalize_identifier), lambda x: x != "")).alias("c_tags"))
    common = q_tags.select("q_id", F.size("q_tags").alias("n_q"), F.explode("q_tags").alias("tag")).join(
        c_tags.select("c_id", F.size("c_tags").alias("n_c"), F.explode("c_tags").alias("tag")), "tag"
    ).groupBy("q_id", "c_id").agg(F.count(F.lit(1)).alias("both"), F.first("n_q").alias("n_q"), F.first("n_c").alias("n_c"))
    tags = common.select("q_id", "c_id", (F.col("both") / (F.col("n_q") + F.col("n_c") - F.col("both"))).alias("tags"))
    by_term, lexical = tfidf_scores(queries, chunks), lexical_scores(queries, chunks)
    keys = ["q_id", "c_id"]
    parts = lexical.join(by_term, keys, "full_outer").join(tags, keys, "full_outer").join(exact, keys, "full_outer")
    if prior_kind is not None:
        parts = parts.join(chunks.select("c_id", F.when(F.col("c_kind") == prior_kind, 1.0).otherwise(0.0).alias("prior")), "c_id")
    else:
        parts = parts.withColumn("prior", F.lit(0.0))
    parts = parts.na.fill(0.0, ["exact", "tags", "tfidf", "lexical"])
    total = sum(F.lit(SCORE[c]) * F.col(c) for c in ("exact", "tags", "tfidf", "lexical", "prior"))
    names = ("exact", "tags", "tfidf", "lexical", "prior")
    return parts.select(*keys, *[rounded(F.col(c)).alias(c) for c in names], rounded(F.least(F.lit(1.0), total)).alias("score"))


def _described(rows: DataFrame, key: str, text: str, more: list[str], short: int | None) -> DataFrame:
    """key, more columns, and of each text its grams, label words, tags, and identifiers (of the whole text up to ``short``)."""
    read = spread(rows).select(key, *more, grams(text).alias("grams"), normalize_label(text).alias("label"), component_tokens(text).alias("found"))
    folded = read.withColumns({"whole": F.replace("label", F.lit(" "), F.lit("")), "tags": F.array_distinct(normalize_identifiers("found"))})
    own = F.array("whole") if short is None else F.when(F.length("whole") <= short, F.array("whole")).otherwise(F.array().cast("array<string>"))
    exact = F.array_distinct(F.filter(F.concat(own, "tags"), lambda x: x != ""))
    return folded.select(key, *more, "grams", F.filter(F.split("label", " "), lambda t: t != "").alias("lexical"), "tags", exact.alias("exact"))


def _tfidf_sides(queries: DataFrame, chunks: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Weighted query terms (q_id, part, term, w), and per chunk (c_id, tfidf array) the length of its weighted terms.

    ``queries``: q_id, grams.  ``chunks``: c_id, grams.
    """
    counts = scratch.save(chunks.select("c_id", F.explode("grams").alias("term")).groupBy("c_id", "term").agg(F.count(F.lit(1)).cast("double").alias("w")))
    idf = scratch.save(inverse_frequency(counts, chunks))
    lengths = counts.join(idf, "term").groupBy("c_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w") * F.col("idf") * F.col("idf"))).alias("tfidf_norm"))
    asked = scratch.save(term_counts(queries, "q_id", F.col("grams")).join(idf, "term").select("q_id", "term", "idf", (F.col("w") * F.col("idf")).alias("w")))
    own = asked.groupBy("q_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    postings = asked.join(own, "q_id").select("q_id", F.lit("tfidf").alias("part"), "term", (F.col("w") * F.col("idf") / F.col("n")).alias("w"))
    return postings, lengths


def tfidf_search(queries: DataFrame, chunks: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """q_id, c_id, tfidf (``digits`` places), rank: the ``k`` best chunks that share a term with the query.

    ``queries``: q_id, q_text.  ``chunks``: c_id, c_text.  Ties go to the smaller chunk id.
    """
    scratch = Scratch(queries.sparkSession, "tfidf")
    held = scratch.save(spread(chunks).select("c_id", grams("c_text").alias("grams")))
    postings, lengths = _tfidf_sides(queries.select("q_id", grams("q_text").alias("grams")), held, scratch)
    rows = held.join(lengths, "c_id", "left").select("c_id", F.col("grams").alias("tfidf"), "tfidf_norm")
    found = best_chunks(queries.select("q_id"), postings, rows, [Part("tfidf", 1.0, "dot")], k, [], digits, False)
    return found.select("q_id", "c_id", "tfidf", "rank")


def hybrid_search(queries: DataFrame, chunks: DataFrame, k: int, filters: tuple[str, ...] = ()) -> DataFrame:
    """q_id, c_id, the parts and total of the hybrid score (4 places), rank: the ``k`` best chunks of each query.

    ``queries``: q_id, q_text.  ``chunks``: c_id, c_text.  ``filters`` names columns q_<name> and c_<name> of both sides
    (such as document, family, kind): a query takes only chunks of its value, all if it is null; term weights count all
    chunks.  A query that asks for a kind gives chunks of that kind the prior.  Chunks that share nothing fill up to
    ``k`` hits, by id.  Blank queries have no hits.
    """
    scratch = Scratch(queries.sparkSession, "hybrid")
    asked = queries.where(F.trim("q_text") != "")
    q = scratch.save(_described(asked, "q_id", "q_text", [f"q_{f}" for f in filters], None))
    c = scratch.save(_described(chunks, "c_id", "c_text", [f"c_{f}" for f in filters], 40))
    postings, lengths = _tfidf_sides(q, c, scratch)
    counts = scratch.save(term_counts(q, "q_id", F.col("lexical")))
    own = counts.groupBy("q_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    postings = postings.unionByName(counts.join(own, "q_id").select("q_id", F.lit("lexical").alias("part"), "term", (F.col("w") / F.col("n")).alias("w")))
    for part in ("tags", "exact"):
        postings = postings.unionByName(q.select("q_id", F.lit(part).alias("part"), F.explode(part).alias("term"), F.lit(1.0).alias("w")))
    rows = c.join(lengths, "c_id", "left").withColumnRenamed("grams", "tfidf")
    parts = [Part("exact", SCORE["exact"], "any"), Part("tags", SCORE["tags"], "share"), Part("tfidf", SCORE["tfidf"], "dot"), Part("lexical", SCORE["lexical"], "dot")]
    found = best_chunks(q.select("q_id", *[f"q_{f}" for f in filters]), postings, rows, parts, k, list(filters), 4, True, SCORE["prior"])
    return found


def search(scored: DataFrame, k: int) -> DataFrame:
    """The k best chunks of each query among scored pairs, by score down and chunk id, with their rank."""
    window = Window.partitionBy("q_id").orderBy(F.desc("score"), "c_id")
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def bundles(hits: DataFrame) -> DataFrame:
    """One row per query: its hits in order, supporting and contradicting ones, best score; at most k hits each."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "c_id", "score", "exact")))
    pick = lambda test: F.transform(F.filter("hits", test), lambda h: h["c_id"])
    return hits.groupBy("q_id").agg(ordered.alias("hits")).select(
        "q_id",
        F.transform("hits", lambda h: h["c_id"]).alias("hit_ids"),
        pick(lambda h: h["score"] >= SUPPORT).alias("support"),
        pick(lambda h: (h["exact"] <= 0) & (h["score"] < CONTRADICTION)).alias("contradiction"),
        F.get("hits", F.lit(0))["score"].alias("top_score"),
    )


def bundle_id(query: Column | str, hit_ids: Column | str) -> Column:
    """Stable id of a query with its hits."""
    return F.concat(F.lit("bundle:"), F.substring(F.sha1(F.concat_ws("::", query, F.array_join(hit_ids, "|")).cast("binary")), 1, 16))


cosine_search = nearest_vectors


# ---------------------------------------------------------------- evidence graph


def same_document_edges(chunks: DataFrame) -> DataFrame:
    """Edges between chunks that follow each other in a document."""
    pairs = consecutive_pairs(chunks, "c_id", ["document"], ["ord", "c_id"])
    return _edge(pairs.withColumn("reason", F.col("document")), "same_document", 0.2)


def shared_identifier_edges(chunks: DataFrame, hot: int | None = None, tile: int = TILE_ROWS) -> DataFrame:
    """Edges between chunks that share an identifier: every pair, however many chunks hold it.

    The chunks of an identifier are spread over tiles of about ``tile`` chunks, and every two tiles meet under a key of
    their own, so no task holds all pairs of one identifier.  Only if ``hot`` is given, an identifier of more chunks than
    that links each chunk to the first of them instead (a star).
    """
    held = chunks.select("c_id", "ord", F.explode(identifiers("c_text", short=None)).alias("identifier")).distinct()
    sizes = held.groupBy("identifier").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "c_id")).alias("first")).where("n > 1")
    sized = held.join(sizes, "identifier")
    tiles = F.ceil(F.col("n") / F.lit(tile)).cast("bigint")
    paired = sized if hot is None else sized.where(F.col("n") <= hot)
    spread = paired.select("identifier", F.struct("ord", "c_id").alias("x"), tiles.alias("tiles"), F.pmod(F.xxhash64("ord", "c_id"), tiles).alias("own"))
    left = spread.select("identifier", F.col("x").alias("l"), F.col("own").alias("a"), F.explode(F.sequence("own", F.col("tiles") - 1)).alias("b"))
    right = spread.select("identifier", F.col("x").alias("r"), F.explode(F.sequence(F.lit(0).cast("bigint"), "own")).alias("a"), F.col("own").alias("b"))
    met = left.join(right, ["identifier", "a", "b"]).where("a < b or l < r")
    pairs = met.select("identifier", F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).select(
        "identifier", F.col("l.c_id").alias("from_id"), F.col("r.c_id").alias("to_id")
    )
    edges = pairs
    if hot is not None:
        star = sized.where((F.col("n") > hot) & (F.col("c_id") != F.col("first.c_id")))
        edges = pairs.unionByName(star.select("identifier", F.col("first.c_id").alias("from_id"), F.col("c_id").alias("to_id")))
    named = _edge(edges.withColumn("reason", F.col("identifier")), "shared_identifier", 1.0)
    return named.withColumn("edge_id", F.concat_ws("::", "edge_id", "reason"))


def _edge(pairs: DataFrame, kind: str, score: float) -> DataFrame:
    return pairs.select(
        F.concat_ws("::", F.col("from_id").cast("string"), F.col("to_id").cast("string"), F.lit(kind)).alias("edge_id"),
        "from_id", "to_id", F.lit(kind).alias("edge_type"), F.lit(score).alias("score"), "reason",
    )


def tag_similarity(left: Column | str, right: Column | str) -> Column:
    """Jaccard of two arrays of designations after folding."""
    fold = lambda c: F.array_distinct(F.filter(F.transform(c, normalize_identifier), lambda x: x != ""))
    return jaccard(fold(left), fold(right))
