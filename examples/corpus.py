"""Source files, changes and query texts derived from the given tables, row by row.

The tables hold no C code, so every row of ``part`` and ``documents`` is rendered as a source file
whose functions are known from the row's columns.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from declarium.plans.shared import spread
from declarium.operators.extract import explode_functions, extract_functions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def pick(number: Column, *values: str) -> Column:
    """The value at ``number`` modulo the number of values."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (number % len(values)).cast("int") + 1)


def part_columns() -> SimpleNamespace:
    """What the file of a part is made of, over the columns of ``part``."""
    key, size = F.col("p_partkey"), F.col("p_size")
    key_text = key.cast("string")
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    folder = F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))
    path = F.concat(F.lit("src/"), folder, F.lit("/"), key_text, pick(size, ".c", ".cpp", ".h"))
    head = F.concat(
        F.lit("/* "), F.col("p_type"), F.lit("; int not_here(int x); */\n#define P_"), key_text,
        F.lit("(x) \\\n  int macro_fn(int x) { }\n/* é */ "),
    )
    first = F.concat(
        pick(size, "int ", "static void ", "const char *", "size_t ", "struct P *"),
        name,
        F.lit("("),
        pick(key, "void", "int a", "char const* s, size_t n", "int (*cb)(int x, int), ..."),
        F.lit(")"),
        pick(key, ";", " {\n  if (a > '}') { call(\"{\", 1); }\n}"),
    )
    second = F.concat(F.lit(" unsigned long int get_"), key_text, F.lit("(struct P * p, char *v[])\n;\n"))
    return SimpleNamespace(
        key=key, key_text=key_text, size=size, name=name, path=path, code=F.concat(head, first, second)
    )


def _binary(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def _files(rows: DataFrame, path: Column, text: Column, mtime: Column) -> DataFrame:
    content = _binary(text)
    return rows.select(
        path.alias("path"), mtime.cast("double").alias("mtime"),
        F.octet_length(content).cast("bigint").alias("size"), content.alias("content"),
    )


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per part: two functions, a comment and a macro that only look like some."""
    part = part_columns()
    return _files(table(spark, sf_dir, "part"), part.path, part.code, F.lit(1.0))


def later_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files later: some edited, some broken, some emptied, most as they were."""
    part = part_columns()
    what = part.key % 7
    text = (
        F.when(what == 0, F.concat(F.lit("int edited_"), part.key_text, F.lit("(int a);\n"), part.code))
        .when(what == 1, F.concat(part.code, F.lit("int broken(int a) {\n")))
        .when(what == 2, F.lit("/* nothing left */\n"))
        .otherwise(part.code)
    )
    return _files(table(spark, sf_dir, "part"), part.path, text, F.when(what <= 2, 2.0).otherwise(1.0))


def damaged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with one kind of damage each; one kind is none."""
    part = part_columns()
    ending = pick(part.key, "", "/* open", "char *s = \"open;\n", "int f(int a) {\n", "int f((int a);\n", "namespace n { }\n")
    return _files(table(spark, sf_dir, "part"), part.path, F.concat(part.code, ending), F.lit(1.0))


def nested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose brackets of each kind are as deep as the key of the part says, up to 300."""
    part = part_columns()
    depth = (part.key % 300 + 1).cast("int")
    text = F.concat(
        F.lit("int deep_"), part.key_text, F.lit("(int a["), F.repeat(F.lit("("), depth), F.lit("1"), F.repeat(F.lit(")"), depth), F.lit("]) "),
        F.repeat(F.lit("{"), depth), F.repeat(F.lit("}"), depth), F.lit(" long next_"), part.key_text, F.lit("("),
        F.repeat(F.lit("A<"), depth), F.lit("int, char"), F.repeat(F.lit(">"), depth), F.lit(" x, short y);\n"),
    )
    return _files(table(spark, sf_dir, "part"), part.path, text, F.lit(1.0))


def conditional_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with heads in two branches, dead prose, and branches in a parameter list."""
    part = part_columns()
    dead = F.concat(F.lit("#if 0\ndon't read { "), F.col("p_name"), F.lit("\nint dead(int a);\n#endif\n"))
    head = F.concat(F.lit("#ifdef A\nint f_"), part.key_text, F.lit("(int a) {\n#else\nint f_"), part.key_text, F.lit("(long a) {\n#endif\n return 0; }\n"))
    listed = F.concat(F.lit("void g_"), part.key_text, F.lit("(char c,\n#if B\n short b\n#elif C\n int b\n#else\n long b\n#endif\n);\n"))
    lists = F.concat(F.lit("int a_"), part.key_text, F.lit("(int x), *b_"), part.key_text, F.lit("(char y);\n"))
    return _files(table(spark, sf_dir, "part"), part.path, F.concat(pick(part.key, "", "\n\n"), dead, head, listed, lists), F.lit(1.0))


def directive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a head behind many conditional groups: up to 40, and 10,000 in every 500th file."""
    part = part_columns()
    groups = F.when(part.key % 500 == 0, F.lit(10_000)).otherwise((part.key % 41).cast("int"))
    text = F.concat(F.repeat(F.lit("#if 0\n{ '\n#endif\n"), groups), F.lit("int f_"), part.key_text, F.lit("(int a);\n"))
    return _files(table(spark, sf_dir, "part"), part.path, text, F.lit(1.0))


def declarator_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with heads behind initialised variables and types defined in place, old-style and scoped ones,
    variables that look like heads, and some that no form fits."""
    part = part_columns()
    k = part.key_text
    every = F.concat(
        F.lit("int n = 1, *init_"), k, F.lit("(char c), z[2] = { 1, 2 };\nAPI(int) lost_"), k, F.lit("(int a);\nstruct P_"), k,
        F.lit(" { int x; struct { int y; } q; } make_"), k, F.lit("(struct P_"), k, F.lit(" *p, int a) { return *p; }\n"))
    old = F.concat(F.lit("long old_"), k, F.lit("(a, s, cb) int a; char *s; int (*cb)();\n{ }\n"))
    scoped = F.concat(
        F.lit("namespace ns { int in_"), k, F.lit("(int a); }\nlong ns::out_"), k, F.lit("(short b) { }\nint Other::lost_"), k,
        F.lit("(int c) { }\nstd::string var_"), k, F.lit("(n); std::string fun_"), k, F.lit("(size_t);\n"))
    own = F.when(part.size % 3 == 0, old).when(part.size % 3 == 1, scoped).otherwise(F.lit(""))
    return _files(table(spark, sf_dir, "part"), part.path, F.concat(every, own), F.lit(1.0))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document: its whole text in a comment and again in a string literal."""
    doc = F.col("doc_id").cast("string")
    comment = F.replace(F.col("text"), F.lit("*/"), F.lit("* /"))
    quoted = F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    literal = F.replace(F.replace(quoted, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    text = F.concat(
        F.lit("/* "), comment, F.lit(" */\nint doc_"), doc, F.lit('(const char *text);\nconst char *t = "'), literal,
        F.lit('"; size_t len_'), doc, F.lit("(void) { return 0; }\n"),
    )
    path = F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), doc, F.lit(".h"))
    return _files(table(spark, sf_dir, "documents"), path, text, F.lit(1.0))


def code_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions extracted from :func:`code_files`."""
    return explode_functions(extract_functions(code_files(spark, sf_dir)), "path")


def part_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per part: by name and signature, by one of them, misspelt, with wildcards."""
    part = part_columns()
    signature = pick(part.size, "int (int)", "void (const  char*, size_t)", "const char * (int (*)(int, int), ...)", "size_t ()")
    text = (
        F.when(part.key % 6 == 0, F.concat(part.name, F.lit(" :: "), signature))
        .when(part.key % 6 == 1, signature)
        .when(part.key % 6 == 2, F.concat(F.upper(part.name), F.lit(" ::")))
        .when(part.key % 6 == 3, F.concat(F.lit("q"), part.name, F.lit("zz :: ")))
        .when(part.key % 6 == 4, F.concat(F.substring(part.name, 1, 2), F.lit("%"), F.substring(part.name, -3, 3), F.lit("::")))
        .otherwise(F.lit("  "))
    )
    return table(spark, sf_dir, "part").select(part.key.alias("query_id"), text.alias("query_text"))


def supplier_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per supplier, none of which a name contains."""
    key = F.col("s_suppkey")
    name = F.concat(F.lit("Get"), (key * 7).cast("string"), pick(key, "", "_widget", "_bolt"))
    text = F.concat(name, F.lit(" :: "), pick(key, "unsigned long (struct P *, char *[])", "int (int)", "", "size_t (char)"))
    return table(spark, sf_dir, "supplier").select(key.alias("query_id"), text.alias("query_text"))
