"""Schema linking: tokenise (P6), BM25 over tables (G7, J10), rank (W2), foreign-key closure
(J6) and the budgeted table choice (W3).

A "database" is a group of "tables" (documents), each with a text: a few dozen tables a database, in
the scaled fixture all documents of one source. Scoring is a join of exploded postings, ranking is a
group-limited window (Spark inserts a partial top-k before the shuffle), and the closure folds a
database's FK list, which its catalog row holds as one array anyway, over a question's few seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import maybe_broadcast, spread, stored
from ..functions.text import col_

# --- fixed values -----------------------------------------------------------------------------
TOKEN_RE = "[A-Za-z][A-Za-z0-9_]*"
SNAKE_RE = "[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]*"
BM25_K1 = 1.5
BM25_B = 0.75
BM25_MIN_DENOM = 1e-9
MIN_TABLES_KEPT = 2
SCHEMA_MAX_TOKENS = 1500
TOKENS_PER_CHAR = 0.30
ROW_TERMS = 64  # a database's question terms that are compared with a document's words in the row
# ----------------------------------------------------------------------------------------------


def schema_budget_chars(max_tokens: int = SCHEMA_MAX_TOKENS, tokens_per_char: float = TOKENS_PER_CHAR) -> int:
    """The schema block's character budget, ``int(max_tokens / max(ratio, 1e-3))``."""
    return int(max_tokens / max(tokens_per_char, 1e-3))


SCHEMA_BUDGET_CHARS = schema_budget_chars()


def tokenize(text: Column | str) -> Column:
    """Lower-case words ``[A-Za-z][A-Za-z0-9_]*``; each word's non-empty ``_`` pieces, then
    the whole word again when it contains ``_``. Multiplicity and order are kept.

    A text without ``_`` (almost all prose) is just its word list -- one regex scan; only texts
    with ``_`` pay for the per-word split (a JVM higher-order function, no Python).
    """
    t = col_(text)
    words = F.regexp_extract_all(F.lower(t), F.lit(TOKEN_RE), 0)
    split_words = F.flatten(
        F.transform(
            words,
            lambda w: F.when(
                w.contains("_"),
                F.concat(F.filter(F.split(w, "_"), lambda p: p != ""), F.array(w)),
            ).otherwise(F.array(w)),
        )
    )
    return F.when(F.instr(t, "_") == 0, words).otherwise(split_words)


def term_bag(text: Column | str) -> Column:
    """P6 as a multiset (order not kept), with regexes only -- no per-word lambdas.

    Every word is a token once (a word without ``_`` is its own single piece; a word with ``_``
    is added whole), and the pieces of the ``_`` words are the alphanumeric runs of those words.
    A match of ``SNAKE_RE`` is exactly a word containing ``_``: it must start at a word's first
    letter, because a word without ``_`` offers no ``_`` to any later start inside it.
    """
    t = col_(text)
    low = F.lower(t)
    words = F.regexp_extract_all(low, F.lit(TOKEN_RE), 0)
    snake = F.regexp_extract_all(low, F.lit(SNAKE_RE), 0)
    pieces = F.regexp_extract_all(F.array_join(snake, " "), F.lit("[A-Za-z0-9]+"), 0)
    return F.when(F.instr(t, "_") == 0, words).otherwise(F.concat(words, pieces))


def query_terms(questions: DataFrame, text_col: str = "question") -> DataFrame:
    """(question_id, db_id, term, qtf): query tokens with multiplicity."""
    return (
        questions.select("question_id", "db_id", F.explode(tokenize(text_col)).alias("term"))
        .groupBy("question_id", "db_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def _row_terms(corpus: DataFrame, lists: DataFrame) -> DataFrame:
    """(db_id, table_index, mterm, tf) with each document's words compared with its database's few question terms in
    the row: only hits are exploded, and one row more with a null term that counts the other words."""
    bags = spread(corpus.select("db_id", "table_index", "text")).join(lists, "db_id").select(
        "db_id", "table_index", "__words", term_bag("text").alias("__bag"))
    hits = bags.withColumn("__hits", F.filter("__bag", lambda w: F.array_contains("__words", w)))
    one = F.transform("__hits", lambda w: F.struct(w.alias("mterm"), F.lit(1).alias("n")))
    rest = F.struct(F.lit(None).cast("string").alias("mterm"), (F.size("__bag") - F.size("__hits")).alias("n"))
    no_text = F.array(F.struct(F.lit(None).cast("string").alias("mterm"), F.lit(0).alias("n")))
    found = hits.select("db_id", "table_index", F.inline(
        F.when(F.col("__bag").isNull(), no_text).otherwise(F.concat(one, F.array(rest)))))
    return found.groupBy("db_id", "table_index", "mterm").agg(F.sum("n").alias("tf"))


def _row_scores(corpus: DataFrame, qt: DataFrame, k1: float, b: float) -> DataFrame:
    """``bm25_scores`` with each database's documents in one row: one shuffle by database of the words and of the
    question terms, and no posting leaves its row. Documents of equal table_index are one document."""
    words = corpus.select("db_id", "table_index", F.coalesce(term_bag("text"), F.array().cast("array<string>")).alias("bag"))
    docs = F.col("__docs")
    apart = F.array_distinct(F.transform(docs, lambda d: d["table_index"]))
    merged = F.transform(apart, lambda i: F.struct(i.alias("table_index"), F.flatten(F.transform(
        F.filter(docs, lambda d: d["table_index"].eqNullSafe(i)), lambda d: d["bag"])).alias("bag")))
    dbs = words.groupBy("db_id").agg(F.collect_list(F.struct("table_index", "bag")).alias("__docs")).select(
        "db_id", F.when(F.size(apart) < F.size(docs), merged).otherwise(docs).alias("__docs"))
    n = F.size("__docs")
    total = F.aggregate("__docs", F.lit(0).cast("long"), lambda a, d: a + F.size(d["bag"]))
    dbs = dbs.select("db_id", "__docs", n.alias("__n"), (total / n).alias("__avgdl"))
    asked = qt.groupBy("question_id", "db_id").agg(F.collect_list(F.struct("term", "qtf")).alias("__terms"))

    def weight(t):
        df = F.size(F.filter("__docs", lambda d: F.array_contains(d["bag"], t["term"])))
        return F.struct(t["term"].alias("term"), df.alias("df"),
                        (t["qtf"] * F.log(1.0 + (F.col("__n") - df + 0.5) / (df + 0.5))).alias("w"))

    weighted = asked.join(dbs, "db_id").select(
        "question_id", "db_id", "__docs", "__avgdl",
        F.filter(F.transform("__terms", weight), lambda t: t["df"] > 0).alias("__terms"))

    def score(d):
        norm = F.when(F.col("__avgdl") > 0, F.size(d["bag"]) / F.col("__avgdl")).otherwise(F.lit(0.0))
        tf = lambda t: F.size(F.filter(d["bag"], lambda w: w == t["term"]))
        shared = F.transform(F.filter("__terms", lambda t: F.array_contains(d["bag"], t["term"])),
                             lambda t: F.struct(t["w"].alias("w"), tf(t).alias("tf")))
        return F.struct(d["table_index"].alias("table_index"), F.aggregate(shared, F.lit(None).cast("double"), lambda a, t: F.coalesce(
            a, F.lit(0.0)) + t["w"] * (t["tf"] * (k1 + 1)) / F.greatest(t["tf"] + k1 * (1 - b + b * norm), F.lit(BM25_MIN_DENOM))).alias("score"))

    return weighted.select("question_id", "db_id", F.inline(F.transform("__docs", score))).where(
        F.col("score").isNotNull() & F.col("table_index").isNotNull())


def bm25_scores(corpus: DataFrame, questions: DataFrame, k1: float = BM25_K1, b: float = BM25_B,
                broadcast_rows: int = 2_000_000, small_databases: bool = False) -> DataFrame:
    """G7 + J10: BM25 of every (question, table of the question's database) pair that shares a
    term. Pairs sharing nothing score 0.0 and are not emitted (no all-pairs product).

    corpus: (db_id, table_index, text); questions: (question_id, db_id, question).
    Output: (question_id, db_id, table_index, score). ``small_databases``: every database has a few dozen documents
    at most, as those of a catalog, so that a row may hold a database.

    Plan: the corpus is read and tokenised once. Each token is marked against the query
    vocabulary -- in the document's row where no database has more than ``ROW_TERMS`` query terms, else by a join
    (broadcast when a count proves it small) -- and one aggregation keyed by
    (db, table, vocabulary-term-or-NULL) yields both the postings and, summed per table, the
    document length. That table is checkpointed once and read by every branch. Only vocabulary
    terms and one row per document leave the map side.
    """
    qt = query_terms(questions)
    if small_databases:
        return stored(_row_scores(corpus, qt, k1, b), "terms-scored")
    vocab = qt.select("db_id", "term").distinct()
    sizes = vocab.groupBy("db_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("dbs"), F.max("n").alias("most")).first()
    if sizes["dbs"] and sizes["most"] <= ROW_TERMS:
        lists = vocab.groupBy("db_id").agg(F.collect_list("term").alias("__words"))
        small = sizes["dbs"] * sizes["most"] <= broadcast_rows and sizes["dbs"] * sizes["most"] * 48 <= 64 * 1024 * 1024
        agg = _row_terms(corpus, F.broadcast(lists) if small else lists)
    else:
        vocab = maybe_broadcast(vocab.withColumn("__hit", F.lit(True)), max_rows=broadcast_rows, row_bytes=48)
        # statistics are per database, so databases that nobody asks about need no tokens
        asked = maybe_broadcast(questions.select("db_id").distinct(), max_rows=broadcast_rows, row_bytes=24)
        toks = spread(corpus.select("db_id", "table_index", "text").join(asked, "db_id", "left_semi")).select(
            "db_id", "table_index", F.explode_outer(term_bag("text")).alias("term"))
        marked = toks.join(vocab, on=["db_id", "term"], how="left").select(
            "db_id", "table_index", "term", F.when(F.col("__hit"), F.col("term")).alias("mterm"))
        agg = marked.groupBy("db_id", "table_index", "mterm").agg(F.count("term").alias("tf"))
    # Small (one row per document plus its vocabulary hits) and read by three branches whose
    # pushed-down filters differ, so Spark cannot reuse the shuffle: materialise it once in the
    # shared folder -- the text is read and tokenised exactly once.
    agg = stored(agg, "terms")
    dl = agg.groupBy("db_id", "table_index").agg(F.sum("tf").alias("dl"))
    # Per-database statistics include documents with zero tokens.
    stats = dl.groupBy("db_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    postings = agg.filter(F.col("mterm").isNotNull()).select("db_id", "table_index",
                                                             F.col("mterm").alias("term"), "tf")
    dfs = postings.groupBy("db_id", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = dfs.join(stats, on="db_id").select(
        "db_id", "term", "avgdl",
        F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"),
    )
    weighted = qt.join(idf, on=["db_id", "term"])
    norm = F.when(F.col("avgdl") > 0, F.col("dl") / F.col("avgdl")).otherwise(F.lit(0.0))
    denom = F.greatest(F.col("tf") + k1 * (1 - b + b * norm), F.lit(BM25_MIN_DENOM))
    contrib = F.col("qtf") * F.col("idf") * (F.col("tf") * (k1 + 1)) / denom
    return (
        postings.join(dl, on=["db_id", "table_index"])
        .join(weighted, on=["db_id", "term"])
        .groupBy("question_id", "db_id", "table_index")
        .agg(F.sum(contrib).alias("score"))
    )


def first_tables(corpus: DataFrame, k: int) -> DataFrame:
    """The k lowest table indexes of every database (zero-score fill for ranking)."""
    w = Window.partitionBy("db_id").orderBy("table_index")
    return (corpus.select("db_id", "table_index").withColumn("__r", F.row_number().over(w))
            .filter(F.col("__r") <= k).drop("__r"))


def top_tables(scores: DataFrame, corpus: DataFrame, questions: DataFrame, k: int = MIN_TABLES_KEPT,
               score_digits: int = 9) -> DataFrame:
    """The k best tables per question, by score descending then table index.

    Tables without a shared term score 0; the only zero-score tables that can reach the top k
    are a database's k lowest indexes, so those are added per question (k rows each) instead of
    materialising every (question, table) pair. Output adds ``rank`` (1-based).
    """
    fill = questions.select("question_id", "db_id").join(first_tables(corpus, k), on="db_id").withColumn(
        "score", F.lit(0.0))
    cand = (
        scores.select("question_id", "db_id", "table_index", "score").unionByName(fill)
        .groupBy("question_id", "db_id", "table_index").agg(F.max("score").alias("score"))
    )
    w = Window.partitionBy("question_id").orderBy(F.round("score", score_digits).desc(), F.col("table_index"))
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fk_lists(edges: DataFrame) -> DataFrame:
    """(db_id, fks): each database's foreign keys in list order. A catalog row holds the same list as one
    array already (A1), so this is bounded by the catalog, not by the questions."""
    fk = F.struct(F.col("pos").cast("long").alias("pos"), F.col("from_table").alias("a"), F.col("to_table").alias("b"))
    return edges.groupBy("db_id").agg(F.array_sort(F.collect_list(fk)).alias("fks"))


def fold_closure(kept: Column, fks: Column) -> Column:
    """J6 in a row: the pipeline's one ordered pass over the FK list, where a key that touches a kept
    table keeps both its ends."""
    def step(acc, fk):
        touches = F.array_contains(acc, fk["a"]) | F.array_contains(acc, fk["b"])
        return F.when(touches, F.array_union(acc, F.array(fk["a"], fk["b"]))).otherwise(acc)

    return F.when(fks.isNull(), kept).otherwise(F.aggregate(fks, kept, step))


def closed_sets(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(question_id, db_id, tables): each question's seeds closed over its database's FK list, in table
    order. One join on the database and a fold in the row; no rounds, whatever the length of a chain."""
    tables = F.array_distinct(F.collect_list(F.col("table_index").cast("long")))
    per = seeds.groupBy("question_id", "db_id").agg(tables.alias("__seed"))
    lists = fk_lists(edges.select("db_id", "pos", F.col("from_table").cast("long"), F.col("to_table").cast("long")))
    return per.join(lists, "db_id", "left").select(
        "question_id", "db_id", F.array_sort(fold_closure(F.col("__seed"), F.col("fks"))).alias("tables"))


def fk_closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """The closure of every question's seeds, a row per kept table.

    seeds: (question_id, db_id, table_index); edges: (db_id, pos, from_table, to_table).
    Output: (question_id, db_id, table_index).
    """
    return closed_sets(seeds, edges).select("question_id", "db_id", F.explode("tables").alias("table_index"))


def sized_length(corpus: DataFrame, length_col: Column | None = None) -> DataFrame:
    """Rendered size of a whole database: table block lengths joined by blank lines."""
    ln = length_col if length_col is not None else F.length("text")
    return corpus.groupBy("db_id").agg((F.sum(ln) + 2 * (F.count(F.lit(1)) - 1)).alias("full_chars"))


def prune_schema(corpus: DataFrame, questions: DataFrame, edges: DataFrame,
                 budget_chars: int = SCHEMA_BUDGET_CHARS, min_tables: int = MIN_TABLES_KEPT,
                 size_col: str | None = None) -> DataFrame:
    """W3 (pipeline rule): a database whose full rendering fits the budget keeps every table;
    otherwise the answer is the FK closure of the top ``min_tables`` BM25 tables (growing k
    cannot shrink a closure, so the first k tried is the answer whether it fits or not).

    ``size_col`` names a per-table column with the table's sized length (its CREATE block plus
    raw sample cells); by default the document text's length is used.

    Output: (question_id, db_id, table_index) kept, in table order when sorted.
    """
    size = sized_length(corpus, F.col(size_col) if size_col else None)
    q = questions.join(size, on="db_id", how="left")
    fits = q.filter(F.col("full_chars") <= budget_chars).select("question_id", "db_id")
    over = q.filter(~(F.col("full_chars") <= budget_chars)).select("question_id", "db_id", "question")
    keep_all = fits.join(corpus.select("db_id", "table_index"), on="db_id")
    scores = bm25_scores(corpus, over)
    seeds = top_tables(scores, corpus, over, k=max(min_tables, 1)).select("question_id", "db_id", "table_index")
    closed = fk_closure(seeds, edges)
    return keep_all.select("question_id", "db_id", "table_index").unionByName(closed)


def table_documents(columns: DataFrame, sample_text: DataFrame | None = None) -> DataFrame:
    """BM25 documents of a catalog: per table, its name, its column names in order
    and (if any) its sample cells, joined by spaces.

    columns: A1 output (db_id, table_index, table_name, flat_index, column_name); sample_text:
    (db_id, table_index, sample_text). A table's column list is bounded by the catalog.
    """
    per = columns.groupBy("db_id", "table_index").agg(
        F.first("table_name").alias("table_name"),
        F.array_sort(F.collect_list(F.struct("flat_index", "column_name"))).alias("__cols"))
    text = F.concat_ws(" ", F.col("table_name"), F.array_join(F.transform("__cols", lambda c: c["column_name"]), " "))
    if sample_text is not None:
        per = per.join(sample_text, ["db_id", "table_index"], "left")
        text = F.when(F.col("sample_text").isNotNull(), F.concat_ws(" ", text, F.col("sample_text"))).otherwise(text)
    return per.select("db_id", "table_index", text.alias("text"))


def render_schema_blocks(kept: DataFrame, table_blocks: DataFrame) -> DataFrame:
    """The prompt's schema block per question: the kept tables' blocks (CREATE TABLE, then the
    sample-row block when non-empty) in table order, joined by blank lines; no tables -> ''.

    kept: (question_id, db_id, table_index); table_blocks: (db_id, table_index, ddl,
    sample_block). The kept set is the pruned schema, so the per-question list is bounded.
    """
    parts = F.when(F.coalesce(F.col("sample_block"), F.lit("")) != "",
                   F.concat_ws("\n\n", F.col("ddl"), F.col("sample_block"))).otherwise(F.col("ddl"))
    j = kept.join(table_blocks, ["db_id", "table_index"]).select("question_id", "table_index", parts.alias("part"))
    return j.groupBy("question_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_index", "part"))),
                                 lambda x: x["part"]), "\n\n").alias("schema_block"))
