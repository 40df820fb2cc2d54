"""Queries by name: each takes ``(spark, sf_dir)`` and returns a DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.functions.language import is_cpp, language_candidates
from declarium.functions.query import parse_queries, placeholder_declaration, query_signature_text, query_status
from declarium.functions.signature import (
    format_hit,
    format_params,
    location,
    normalised_signature,
    params_from_json,
    params_to_json,
    plain_signature,
)
from declarium.functions.text import edit_distance, normalise, tokens
from declarium.operators.batch import candidates_batch, search_batch, search_exact_batch
from declarium.operators.changes import detect_changes
from declarium.operators.extract import explode_functions, extract_functions
from declarium.operators.grams import GramTable
from declarium.operators.search import fetch_candidates, search, search_interactive
from declarium.plans.refresh import refresh, refresh_and_search
from declarium.plans.shared import fresh_folder, written
from declarium.sources.code import TableSource
from declarium.sources.index import SignatureIndex
from declarium.streaming.jobs import stream_index, stream_search, watch
from declarium.streaming.progress import StreamProgress
from examples.corpus import (
    code_files,
    code_functions,
    conditional_files,
    damaged_files,
    declarator_files,
    directive_files,
    document_files,
    later_files,
    nested_files,
    part_columns,
    part_queries,
    pick,
    supplier_queries,
    table,
)

def hit() -> list:
    """The columns of a found function."""
    return ["path", "name", "return_type", "signature_norm", "line", F.col("column").alias("col")]



def scan_language(spark, sf_dir):
    files = code_files(spark, sf_dir)
    tried = language_candidates(F.col("path"))
    return files.select("path", F.array_join(tried, ",").alias("languages"), is_cpp(tried[0]).alias("cpp_first"), "size")


def extract(spark, sf_dir):
    return code_functions(spark, sf_dir).select(
        "path", "name", "return_type", params_to_json(F.col("params")).alias("params_json"), "is_variadic", "signature_norm"
    )


def extract_positions(spark, sf_dir):
    return code_functions(spark, sf_dir).select("path", "name", "line", F.col("column").alias("col"))


def extract_documents(spark, sf_dir):
    found = explode_functions(extract_functions(document_files(spark, sf_dir)), "path")
    return found.select("path", "name", "signature_norm", "line", F.col("column").alias("col"))


def extract_errors(spark, sf_dir):
    return extract_functions(damaged_files(spark, sf_dir)).select(
        "path", "last_error", F.size("functions").alias("functions")
    )


def extract_nested(spark, sf_dir):
    found = explode_functions(extract_functions(nested_files(spark, sf_dir)), "path")
    return found.select("path", "name", params_to_json(F.col("params")).alias("params_json"))


def extract_conditional(spark, sf_dir):
    found = explode_functions(extract_functions(conditional_files(spark, sf_dir)), "path")
    return found.select("path", "name", "return_type", params_to_json(F.col("params")).alias("params_json"), "line", "column")


def extract_directives(spark, sf_dir):
    found = explode_functions(extract_functions(directive_files(spark, sf_dir)), "path")
    return found.select("path", "name", "line", "column")


def extract_declarators(spark, sf_dir):
    found = explode_functions(extract_functions(declarator_files(spark, sf_dir)), "path", "unparsed")
    return found.select("path", "name", "return_type", params_to_json(F.col("params")).alias("params_json"), "line", "column", "unparsed")


def params_json_unicode(spark, sf_dir):
    pair = F.struct(F.lit("struct P *").alias("type"), F.col("text").alias("name"))
    return table(spark, sf_dir, "documents").select("doc_id", params_to_json(F.array(pair)).alias("params_json"))


def signature_norm(spark, sf_dir):
    part = part_columns()
    kinds = F.array(F.struct(F.lit("int").alias("type"), F.lit("a").alias("name")),
                    F.struct(F.lit("const char *").alias("type"), F.lit(None).cast("string").alias("name")))
    params = F.slice(kinds, F.lit(1), (part.key % 3).cast("int"))
    args = (pick(part.size, "int", "std::vector<int>", "void  *"), params, part.key % 2 == 1)
    return table(spark, sf_dir, "part").select(
        "p_partkey", normalised_signature(*args).alias("signature_norm"), plain_signature(*args).alias("plain")
    )


def _tokenised(rows, key, text):
    return rows.select(
        key, F.size(tokens(F.col(text))).alias("n_tokens"), F.md5(F.encode(normalise(F.col(text)), "UTF-8")).alias("digest")
    )


def tokenise_documents(spark, sf_dir):
    return _tokenised(table(spark, sf_dir, "documents"), "doc_id", "text")


def tokenise_pages(spark, sf_dir):
    return _tokenised(table(spark, sf_dir, "pages"), "page_id", "html")


def query_grammar(spark, sf_dir):
    key, name = part_columns().key, part_columns().name
    text = (
        F.when(key % 13 == 0, F.concat(name, F.lit(" :: int (int, int)")))
        .when(key % 13 == 1, F.concat(name, F.lit(" ::   ")))
        .when(key % 13 == 2, F.concat(F.lit("int "), name, F.lit("(int)")))
        .when(key % 13 == 3, F.concat(F.lit("int "), name, F.lit(" (int)")))
        .when(key % 13 == 4, F.lit("int(int)"))
        .when(key % 13 == 5, F.lit("void *(int)"))
        .when(key % 13 == 6, F.concat(F.lit("const "), name, F.lit(" *")))
        .when(key % 13 == 7, F.lit("int (*)(int)"))
        .when(key % 13 == 8, F.concat(F.lit("ns::"), name, F.lit(" :: int (int)")))
        .when(key % 13 == 9, F.lit("int (int);"))
        .when(key % 13 == 10, F.concat(F.lit("::int __q__ ("), name, F.lit(" *)")))
        .when(key % 13 == 11, F.lit("\t \n"))
        .otherwise(F.concat(name, F.lit("::int  (void)")))
    )
    rows = table(spark, sf_dir, "part").select(key.alias("query_id"), text.alias("query_text"))
    part = query_signature_text(F.col("query_text"))
    return parse_queries(rows).select(
        "query_id", "name", "signature_norm", F.when(part != "", placeholder_declaration(part)).alias("declaration")
    )


def edit_distance_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        edit_distance(F.col("p_name"), F.col("p_type")).alias("to_type"),
        edit_distance(F.col("p_name"), F.col("p_brand")).alias("to_brand"),
        edit_distance(F.col("p_brand"), F.lit("")).alias("to_empty"),
    )


def edit_distance_documents(spark, sf_dir):
    words = F.split("text", r"[ \n]")
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    pairs = F.arrays_zip(
        F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b")
    )
    total = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda s, p: s + edit_distance(p["a"], p["b"]))
    return rows.select("doc_id", F.when(F.size("w") > 1, total).otherwise(F.lit(0)).alias("distance"))


def candidates_name(spark, sf_dir):
    return fetch_candidates(code_functions(spark, sf_dir), "RED_w ::", 300).select(*hit())


def candidates_signature(spark, sf_dir):
    return fetch_candidates(code_functions(spark, sf_dir), "size_t (const char *", 100).select(*hit())


def candidates_both(spark, sf_dir):
    return fetch_candidates(code_functions(spark, sf_dir), "blue_b :: int (int").select(*hit())


def candidates_none(spark, sf_dir):
    return fetch_candidates(code_functions(spark, sf_dir), "  ", 250).select(*hit())


def candidates_unlimited(spark, sf_dir):
    return fetch_candidates(code_functions(spark, sf_dir), "get\\_ :: (struct P *", -1).select(*hit())


def search_top(spark, sf_dir):
    return search(code_functions(spark, sf_dir), "red_widget :: size_t (const char *, size_t)").select("score", *hit())


def search_fallback(spark, sf_dir):
    return search(code_functions(spark, sf_dir), "qqq_widget ::", top=15).select("score", *hit())


def search_interactive_form(spark, sf_dir):
    return search_interactive(code_functions(spark, sf_dir), " bolt :: void (int) ").select("score", *hit())


def search_exhaustive(spark, sf_dir):
    return search(code_functions(spark, sf_dir), "gt_12 :: int (int, char)", top=40, exhaustive=True).select("score", *hit())


def search_batch_parts(spark, sf_dir):
    hits = search_batch(written(code_functions(spark, sf_dir)), part_queries(spark, sf_dir), top=5, candidate_limit=40)
    return hits.select("query_id", "rank", "score", *hit())


def search_batch_unlimited(spark, sf_dir):
    hits = search_batch(written(code_functions(spark, sf_dir)), supplier_queries(spark, sf_dir), top=4, candidate_limit=-1)
    return hits.select("query_id", "rank", "score", *hit())


def search_batch_documents(spark, sf_dir):
    """Passages that documents contain, as signatures of one function per document."""
    texts = table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        F.col("lang").alias("name"),
        F.lit("").alias("return_type"),
        params_from_json(F.lit("[]")).alias("params"),
        normalise(F.col("text")).alias("signature_norm"),
        F.lit(1).alias("line"),
        F.lit(1).alias("column"),
    )
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    found = candidates_batch(written(texts), asked, limit=50)
    return found.select("query_id", "path", "name", F.length("signature_norm").alias("n_chars"))


def search_exact(spark, sf_dir):
    hits = search_exact_batch(written(code_functions(spark, sf_dir)), supplier_queries(spark, sf_dir), top=5)
    return hits.select("query_id", "rank", "score", *hit())


def search_within(spark, sf_dir):
    hits = search_exact_batch(written(code_functions(spark, sf_dir)), part_queries(spark, sf_dir), top=5, max_distance=6)
    return hits.select("query_id", "rank", "score", *hit())


def _user_states(spark, sf_dir):
    """State of one file per user, before and after a day."""
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".c")).alias("path"),
        F.struct(
            (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("mtime"),
            F.round(F.col("value") * 100).cast("bigint").alias("size"),
        ).alias("state"),
        (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")).alias("early"),
    )
    known = events.where("early").groupBy("path").agg(F.max("state").alias("s")).select("path", "s.*")
    observed = events.groupBy("path").agg(F.max("state").alias("s")).select("path", "s.*")
    return observed, known


def change_detection(spark, sf_dir):
    observed, known = _user_states(spark, sf_dir)
    return detect_changes(observed, known).select("path", "size", "status")


def _index(spark, sf_dir, **options) -> tuple[SignatureIndex, list[dict]]:
    """An index of the code files, refreshed with their later versions and once more."""
    index = SignatureIndex(spark, fresh_folder(spark))
    later = TableSource(later_files(spark, sf_dir))
    runs = [refresh(index, TableSource(code_files(spark, sf_dir))), refresh(index, later, **options), refresh(index, later)]
    return index, runs


def index_upsert(spark, sf_dir):
    index, _ = _index(spark, sf_dir)
    return index.files().select("path", "mtime", "size", "last_error", F.col("functions_gen").cast("int").alias("functions_gen"))


def live_functions(spark, sf_dir):
    seventh = table(spark, sf_dir, "part").count() // 7 + 1
    index, _ = _index(spark, sf_dir, max_files_per_batch=seventh)
    return index.functions().select(*hit())


def compacted_functions(spark, sf_dir):
    index, _ = _index(spark, sf_dir)
    index.compact()
    return index.functions().select(*hit())


def index_summary(spark, sf_dir):
    _, runs = _index(spark, sf_dir)
    counts = ["files_total", "files_queued", "files_done", "files_skipped", "files_indexed", "files_failed", "functions_total"]
    rows = [(n, *(run[c] for c in counts)) for n, run in enumerate(runs)]
    return spark.createDataFrame(rows, "run int, " + ", ".join(f"{c} bigint" for c in counts))


def error_files(spark, sf_dir):
    return _index(spark, sf_dir)[0].error_file_count()


def functions_per_file(spark, sf_dir):
    return _index(spark, sf_dir)[0].functions_per_file()


def query_status_of_parts(spark, sf_dir):
    key = part_columns().key
    text = F.when(key % 3 != 0, F.concat(F.col("p_name"), F.lit(" :: int (int)")))
    return query_status(table(spark, sf_dir, "part").select(key.alias("query_id"), text.alias("query_text")))


def index_prune(spark, sf_dir):
    index = SignatureIndex(spark, fresh_folder(spark))
    files = code_files(spark, sf_dir)
    refresh(index, TableSource(files))
    refresh(index, TableSource(files.where(F.length("path") % 3 != 0)), prune=True)
    return index.functions().select("path", "name")


def index_duplicates(spark, sf_dir):
    index = SignatureIndex(spark, fresh_folder(spark))
    files = code_files(spark, sf_dir)
    older = files.withColumn("mtime", F.lit(0.5)).withColumn("content", F.encode(F.lit("int old(int a);"), "UTF-8"))
    refresh(index, TableSource(older.unionByName(files).unionByName(files)))
    return index.functions().select("path", "name")


def refreshed_search(spark, sf_dir):
    index = SignatureIndex(spark, fresh_folder(spark))
    hits = refresh_and_search(index, TableSource(code_files(spark, sf_dir)), "red_widget :: size_t (const char *, size_t)")
    return hits.select("score", *hit())


def params_json(spark, sf_dir):
    encoded = code_functions(spark, sf_dir).select("path", "name", params_to_json(F.col("params")).alias("params_json"))
    broken = F.when(F.length("name") % 5 == 0, F.lit("[[")).otherwise(F.col("params_json"))
    return encoded.select("path", "name", "params_json", F.size(params_from_json(broken)).alias("n_params"))


def format_hits(spark, sf_dir):
    c = F.col
    return code_functions(spark, sf_dir).select(
        location(c("path"), c("line"), c("column")).alias("location"),
        format_params(c("params")).alias("params"),
        format_hit(c("path"), c("line"), c("column"), c("name"), c("return_type"), c("params")).alias("hit"),
    )


def _streamed(df: DataFrame, files: int, folder: str) -> DataFrame:
    """A table as a stream of several files, added to ``folder``."""
    df.repartition(files).write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def stream_index_changes(spark, sf_dir):
    index = SignatureIndex(spark, fresh_folder(spark))
    folder, checkpoint = fresh_folder(spark), fresh_folder(spark)
    for records in (code_files(spark, sf_dir), later_files(spark, sf_dir)):
        stream_index(_streamed(records, 2, folder), index, checkpoint).awaitTermination()
    return index.functions().select(*hit())


def stream_progress(spark, sf_dir):
    """What each of two runs of a stream read, as its listener tells, and what the index committed of it."""
    index = SignatureIndex(spark, fresh_folder(spark))
    folder, checkpoint = fresh_folder(spark), fresh_folder(spark)
    told, rows, name = [], [], fresh_folder(spark).rsplit("/", 1)[1]
    listener = StreamProgress(told.append, name)
    spark.streams.addListener(listener)
    try:
        for run, records in enumerate((code_files(spark, sf_dir), later_files(spark, sf_dir))):
            told.clear()
            query = stream_index(_streamed(records, 2, folder), index, checkpoint, name)
            query.awaitTermination()
            listener.wait(query)
            rows += [(run, t["batch_id"], t["files_read"], t["bytes_read"]) for t in told if t["event"] == "progress"]
    finally:
        spark.streams.removeListener(listener)
    read = spark.createDataFrame(rows, "run int, batch_id bigint, files_read bigint, bytes_read bigint")
    counts = ["files_read", "bytes_read", "files_indexed", "files_failed", "functions_total"]
    both = read.join(index.history().where(F.col("stream") == name), "batch_id")
    return both.groupBy("run").agg(*(F.sum(c).alias(c) for c in counts))


def stream_watch(spark, sf_dir):
    """A source that is listed again after its files were edited."""
    index, checkpoint = SignatureIndex(spark, fresh_folder(spark)), fresh_folder(spark)
    for records in (code_files(spark, sf_dir), later_files(spark, sf_dir)):
        watch(TableSource(records), index, checkpoint).awaitTermination()
    return index.functions().select(*hit())


def stream_search_queries(spark, sf_dir):
    functions = GramTable.of(written(code_functions(spark, sf_dir)), fresh_folder(spark))
    hits = fresh_folder(spark)
    asked = _streamed(part_queries(spark, sf_dir), 2, fresh_folder(spark))
    stream_search(asked, lambda: functions, hits, fresh_folder(spark), top=5, candidate_limit=40).awaitTermination()
    return spark.read.parquet(hits).select("query_id", "rank", "score", *hit())


QUERIES = {
    "scan_language": scan_language,
    "extract_functions": extract,
    "extract_positions": extract_positions,
    "extract_documents": extract_documents,
    "extract_errors": extract_errors,
    "extract_nested": extract_nested,
    "extract_conditional": extract_conditional,
    "extract_directives": extract_directives,
    "extract_declarators": extract_declarators,
    "signature_norm": signature_norm,
    "tokenise_documents": tokenise_documents,
    "tokenise_pages": tokenise_pages,
    "query_grammar": query_grammar,
    "edit_distance_parts": edit_distance_parts,
    "edit_distance_documents": edit_distance_documents,
    "candidates_name": candidates_name,
    "candidates_signature": candidates_signature,
    "candidates_both": candidates_both,
    "candidates_none": candidates_none,
    "candidates_unlimited": candidates_unlimited,
    "search_top": search_top,
    "search_fallback": search_fallback,
    "search_interactive": search_interactive_form,
    "search_exhaustive": search_exhaustive,
    "search_batch": search_batch_parts,
    "search_batch_unlimited": search_batch_unlimited,
    "search_batch_documents": search_batch_documents,
    "search_exact": search_exact,
    "search_within": search_within,
    "change_detection": change_detection,
    "index_upsert": index_upsert,
    "live_functions": live_functions,
    "compacted_functions": compacted_functions,
    "index_summary": index_summary,
    "error_files": error_files,
    "functions_per_file": functions_per_file,
    "query_status": query_status_of_parts,
    "index_prune": index_prune,
    "index_duplicates": index_duplicates,
    "refresh_and_search": refreshed_search,
    "params_json": params_json,
    "params_json_unicode": params_json_unicode,
    "format_hits": format_hits,
    "stream_index": stream_index_changes,
    "stream_search": stream_search_queries,
    "stream_progress": stream_progress,
    "stream_watch": stream_watch,
}
