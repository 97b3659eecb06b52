"""Operators over conversation turns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions.text import let, strip, strip_accents
from auditlake.operators.names import substring_lookup
from auditlake.session import materialise

MIN_ANSWER_CHARS = 20
#: Questions and files of a package that are resolved where they lie.
SMALL_PACKAGE = 512


def intent(text: Column) -> Column:
    plain = strip_accents(text)

    def pick(p):
        hits = [(k, p.rlike("(?iU)" + pattern)) for k, pattern in K.INTENT_PATTERNS]
        return reduce(lambda acc, kv: acc.when(kv[1], kv[0]), hits[1:], F.when(hits[0][1], hits[0][0])).otherwise("chat")

    return F.transform(F.array(plain), pick)[0]


def plan(intent_col: Column) -> Column:
    table = F.create_map(*[x for k, v in K.PLAN_BY_INTENT.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    return F.coalesce(F.try_element_at(table, intent_col), F.array().cast("array<string>"))


def without_errors(turns: DataFrame) -> DataFrame:
    starts = reduce(lambda a, b: a | b, [F.col("text").startswith(p) for p in K.ERROR_PREFIXES])
    return turns.filter(~((F.col("role") == "assistant") & F.coalesce(starts, F.lit(False))))


def last_turns(turns: DataFrame) -> DataFrame:
    """Last user text and last non-blank assistant text of each conversation."""
    user = F.when(F.col("role") == "user", F.col("turn"))
    answer = F.when((F.col("role") == "assistant") & (strip(F.col("text")) != ""), F.col("turn"))
    return turns.groupBy("conv_id").agg(F.max_by("text", user).alias("question"), F.coalesce(F.max_by("text", answer), F.lit("(empty answer)")).alias("answer"))


def citation_verdict(answers: DataFrame) -> DataFrame:
    """Verdict on the sources named in ``answer`` against ``tool_output`` (NULL where no tool ran)."""
    answer, tool = F.coalesce("answer", F.lit("")), F.col("tool_output")
    named = F.regexp_extract_all(answer, F.lit("(?U)" + K.FILE_NAME_PATTERN), 1)
    tags = F.regexp_extract_all(answer, F.lit("(?U)" + K.SOURCE_PATTERN), 1)
    parts = F.filter(F.transform(F.flatten(F.transform(tags, lambda t: F.split(t, "[,;]"))), strip), lambda x: x != "")
    seen = F.transform(F.regexp_extract_all(tool, F.lit("(?U)" + K.FILE_NAME_PATTERN), 1), F.lower)
    staged = answers.withColumn("_cited", F.transform(F.concat(parts, named), F.lower)).withColumn("_seen", seen)
    unknown = F.filter("_cited", lambda x: ~F.exists("_seen", lambda s: F.contains(s, x)))
    verdict = (
        F.when(tool.isNull(), "skipped").when(F.length(strip(answer)) < MIN_ANSWER_CHARS, "too_short").when(F.size("_cited") == 0, "no_source")
        .when(F.size(unknown) > 0, "unknown_source").otherwise("ok")
    )
    cited = F.when(verdict.isin("ok", "unknown_source"), F.array_sort(F.array_distinct("_cited"))).otherwise(F.array().cast("array<string>"))
    return staged.withColumn("verdict", verdict).withColumn("cited", cited).drop("_cited", "_seen")


def _named_files(low: Column) -> Column:
    """Full file names in a question that is in lower case."""
    return F.array_distinct(F.regexp_extract_all(low, F.lit("(?U)" + K.FILE_NAME_PATTERN.replace(r"\b", "")), 1))


def _stem_words(low_name: Column) -> Column:
    """Words of four letters or more in a file name without its ending."""
    stem = F.regexp_replace(low_name, r"\.[^.]*$", "")
    return F.array_distinct(F.filter(F.split(F.translate(stem, "_-", "  "), r"\s+"), lambda w: F.length(w) > 3))


def resolve_files(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """Files a question refers to: full names, or else names sharing a word of four letters or more.

    (package_id, question_id, question) with (package_id, file_name).
    Questions and files are shuffled once, by package, and written once; those
    of a package with at most SMALL_PACKAGE of them are resolved where they
    lie. Of a larger one no more than that is gathered; its questions go
    through joins.
    """
    asked = questions.select("package_id", "question_id", F.lower("question").alias("low"))
    stacked = docs.select("package_id", F.lit(0).alias("kind"), "file_name").unionByName(
        asked.withColumn("kind", F.lit(1)), allowMissingColumns=True).dropna(subset=["package_id"])
    # a rank within a package, in no order but that of kinds: Spark limits it before the shuffle
    ranked = stacked.withColumn("_rank", F.row_number().over(Window.partitionBy("package_id").orderBy("kind"))).filter(F.col("_rank") <= SMALL_PACKAGE + 1)
    gathered = materialise(ranked.groupBy("package_id").agg(
        F.max("_rank").alias("_n"), F.collect_list(F.when(F.col("kind") == 0, F.col("file_name"))).alias("files"),
        F.collect_list(F.when(F.col("kind") == 1, F.struct("question_id", "low"))).alias("asked")), "files-by-package")
    large = gathered.filter(F.col("_n") > SMALL_PACKAGE).select("package_id")

    def file(name: Column) -> Column:
        return let(F.lower(name), lambda low: F.struct(name.alias("file_name"), low.alias("low_name"), _stem_words(low).alias("words")))

    def names(files: Column) -> Column:
        return F.array_distinct(F.transform(files, lambda f: f["file_name"]))

    def resolved(asked: Column, words: Column) -> Column:
        """Files of one question, in whatever wordings it comes: ``asked`` holds these."""
        def of(wanted: Column, hit) -> Column:
            return F.when(F.size(wanted) > 0, names(F.filter("files", hit)))

        full = let(F.flatten(F.transform(asked, lambda q: _named_files(q["low"]))), lambda wanted: of(wanted, lambda f: F.array_contains(wanted, f["low_name"])))
        said = F.filter(words, lambda w: F.exists(asked, lambda q: F.contains(q["low"], w)))
        return let(full, lambda x: F.when(F.size(x) > 0, x).otherwise(let(said, lambda w: of(w, lambda f: F.arrays_overlap(f["words"], w)))))

    ready = gathered.filter((F.col("_n") <= SMALL_PACKAGE) & (F.size("files") > 0) & (F.size("asked") > 0)).select(
        "package_id", F.transform("files", file).alias("files"), F.filter("asked", lambda q: q["low"].isNotNull()).alias("asked"))
    ids = F.array_distinct(F.transform("asked", lambda q: q["question_id"]))
    # the words of a package are made once, not for each question
    found = let(F.array_distinct(F.flatten(F.transform("files", lambda f: f["words"]))), lambda words: F.transform(ids, lambda i: F.struct(
        i.alias("question_id"), resolved(F.filter("asked", lambda q: q["question_id"].eqNullSafe(i)), words).alias("names"))))
    out = ready.select("package_id", F.explode(found).alias("x")).select("package_id", "x.question_id", F.explode("x.names").alias("file_name"))
    if large.isEmpty():
        return out
    return out.unionByName(_resolve_large(asked.join(large, "package_id", "left_semi"), docs.join(large, "package_id", "left_semi")))


def _resolve_large(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """Questions of large packages, by joins.

    Full names are an equi-join; words are looked up by fragment, in the
    questions that name no file.  Files and open questions are written, because
    each of these steps reads them.
    """
    files = materialise(docs.select("package_id", "file_name", F.lower("file_name").alias("low_name")), "files")
    full = asked.select("package_id", "question_id", F.explode(_named_files(F.col("low"))).alias("low_name"))
    explicit = full.join(files, ["package_id", "low_name"]).select("package_id", "question_id", "file_name").distinct()
    explicit = materialise(explicit, "explicit")
    open_questions = materialise(asked.join(explicit.select("package_id", "question_id").distinct(), ["package_id", "question_id"], "left_anti").select("package_id", "question_id", "low"), "open-questions")
    words = files.select("package_id", "file_name", F.explode(_stem_words(F.col("low_name"))).alias("word"))
    hits = substring_lookup(words.select("package_id", "word").distinct(), open_questions.select("package_id", "low").distinct(), "word", "low", ["package_id"])
    loose = open_questions.join(hits, ["package_id", "low"]).join(words, ["package_id", "word"]).select("package_id", "question_id", "file_name").distinct()
    return explicit.unionByName(loose)
