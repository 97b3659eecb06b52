"""Cross-document matching inside a package."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions import match, numbers
from auditlake.functions.numbers import amount_tier, general, plain_whole
from auditlake.functions.text import let, split_words, strip
from auditlake.operators.names import contains_join, share_at_least
from auditlake.operators.rules import text_of
from auditlake.session import materialise

KEYS = ["package_id", "doc_id"]
SMALL_SCOPE = 32
ITEM = ["item_code", "description", "quantity"]
PAIRS = [("invoice", "purchase_order"), ("invoice", "delivery_note"), ("delivery_note", "purchase_order")]
RESULT = "status severity message field_name expected_num expected_str actual_num actual_str source_a source_b".split()


def pick_trio(docs: DataFrame) -> DataFrame:
    """First invoice, delivery note and purchase order of each package that has all three."""
    def first(kind):
        return F.min_by("file_name", F.when(F.col("doc_type") == kind, F.col("doc_ord")))

    wanted = docs.filter(F.col("doc_type").isin(K.TRIO_TYPES))
    trio = wanted.groupBy("package_id").agg(*[first(k).alias(k) for k in K.TRIO_TYPES])
    return trio.filter(F.col("invoice").isNotNull() & F.col("delivery_note").isNotNull() & F.col("purchase_order").isNotNull())


def third_document(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """For two documents of the trio types, the first document of the type that is missing."""
    firsts = docs.filter(F.col("doc_type").isin(K.TRIO_TYPES)).groupBy("package_id", "doc_type").agg(
        F.min_by("file_name", "doc_ord").alias("third_file"))
    kinds = F.array(*[F.lit(k) for k in K.TRIO_TYPES])
    needed = F.array_except(kinds, F.array("type_a", "type_b"))
    asked = requests.withColumn("doc_type", F.when(F.size(needed) == 1, needed[0]))
    return asked.join(firsts, ["package_id", "doc_type"], "left").withColumnRenamed("doc_type", "third_type")


def result(when: Column, *args, **fields) -> Column:
    return F.when(when, F.struct(*result_fields(*args, **fields)))


def result_fields(seq, status, severity, message, field, expected_num=None, actual_num=None,
                  expected_str=None, actual_str=None, source_a=None, source_b=None) -> list[Column]:
    def col(x, t="string"):
        return (x if isinstance(x, Column) else F.lit(x)).cast(t)

    return [
        F.lit(seq).alias("seq"), col(status).alias("status"), col(severity).alias("severity"), col(message).alias("message"),
        col(field).alias("field_name"), col(expected_num, "double").alias("expected_num"), col(expected_str).alias("expected_str"),
        col(actual_num, "double").alias("actual_num"), col(actual_str).alias("actual_str"),
        col(source_a).alias("source_a"), col(source_b).alias("source_b")]


def amount_result(label, a: Column, b: Column, seq: int, source_a=None, source_b=None) -> Column:
    """Tiered comparison of two amounts as one match result."""
    tier = amount_tier(a, b)
    diff = F.abs(a - b)
    pct = F.format_string("%.1f", diff / F.greatest(F.abs(a), F.abs(b)) * 100)
    label = label if isinstance(label, Column) else F.lit(label)
    off = tier != "ok"
    message = (
        F.when(off, text_of(label, ": ", pct, "% diff (", plain_whole(a), " vs ", plain_whole(b), ")"))
        .when(diff <= 1, text_of(label, ": matches (", plain_whole(a), ")"))
        .otherwise(text_of(label, ": diff within rounding tolerance (", plain_whole(diff), ")"))
    )
    return result(
        tier.isNotNull(), seq, F.when(off, F.lit("mismatch")).otherwise(F.lit("match")), tier, message, label,
        F.when(off, a), F.when(off, b), source_a=F.when(off, F.lit(source_a)), source_b=F.when(off, F.lit(source_b)))


def levelled_amounts(a: str, b: str, seq: int, cols: set[str]) -> Column:
    """Gross against gross, else net against net, else generic amounts, else nothing."""
    def col(doc, level):
        name = f"{doc}_{level}"
        return F.col(name) if name in cols else F.lit(None).cast("double")

    out = None
    for level, word in (("total_gross", "Gross total"), ("total_net", "Net total"), ("amount", "Amount")):
        x, y = col(a, level), col(b, level)
        both = x.isNotNull() & y.isNotNull()
        value = amount_result(f"{word} ({a} vs {b})", x, y, seq, a, b)
        out = F.when(both, value) if out is None else out.when(both, value)
    return out


def explode_results(df: DataFrame, results: list[Column], keys=KEYS) -> DataFrame:
    kept = F.filter(F.array(*results), lambda r: r.isNotNull())
    return df.select(*keys, F.explode(F.array(kept)).alias("_every")).select(*keys, F.explode("_every").alias("r")).select(*keys, "r.*")


def date_result(issue: Column, ordered: Column, seq: int) -> Column:
    early = (F.length(issue) >= 10) & (F.length(ordered) >= 10) & (F.substring(issue, 1, 10) < F.substring(ordered, 1, 10))
    return result(early, seq, "mismatch", "warning",
                  text_of("Invoice issue date (", F.substring(issue, 1, 10), ") is earlier than the purchase order date (",
                          F.substring(ordered, 1, 10), ")"),
                  "date", expected_str=ordered, actual_str=issue)


def stacked_items(items: dict[str, DataFrame]) -> DataFrame:
    """Item tables of several kinds of document as one, with their ``kind``."""
    out = None
    for kind, table in items.items():
        part = table.withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _lowered(text: Column) -> Column:
    """Lower case without outer whitespace, which a text that starts and ends with a printable ASCII character has none of."""
    bare = F.ascii(text).between(33, 126) & F.ascii(F.right(text, F.lit(1))).between(33, 126)
    return F.lower(F.when(text.isNull(), "").when(bare, text).otherwise(strip(text)))


def _stated_order(code: Column, description: Column) -> Column:
    """Order of items that come without ``ord``."""
    return F.concat_ws("|", description, code)


def _prepared(entries: str, ordered: bool) -> Column:
    """Items with their order, and code and name as they are compared."""
    return F.transform(entries, lambda e: F.struct(
        e.alias("item"), (e["ord"] if ordered else _stated_order(e["item_code"], e["description"])).alias("ord"),
        _lowered(e["item_code"]).alias("code"), _lowered(e["description"]).alias("name")))


def _sorted(entries: str) -> Column:
    """Items in the order in which they are taken, with what is compared and handed on."""
    return F.sort_array(F.transform(entries, lambda e: F.struct(
        e["ord"], e["item"]["description"].alias("description"), e["item"]["quantity"].alias("quantity"), e["code"], e["name"])))


def _best(a: Column, rights: Column) -> Column:
    """Of the sorted items ``rights`` the place of that which ``a`` is matched with, from 1, times 8, plus the pass; NULL if there is none."""
    def at(place: Column, step: int) -> Column:
        return F.when(place > 0, place * 8 + step)

    def first(hit, step: int) -> Column:
        return let(F.array_position(F.transform(rights, hit), True), lambda place: at(place, step))

    def inside(b: Column) -> Column:
        return F.when(b["name"] != "", F.contains(a["name"], b["name"]) | F.contains(b["name"], a["name"]))

    def alike(numbers: Column):
        # words that differ have no digits, so each number of one name stands in the other
        return lambda b: F.when((b["name"] != "") & F.forall(numbers, lambda x: F.contains(b["name"], x)), match.names_alike(a["name"], b["name"]))

    # one after another: names are searched only for items without an equal one, words only of names with the same numbers
    return F.coalesce(
        at(F.when(a["code"] != "", F.array_position(rights["code"], a["code"])), 1), at(F.array_position(rights["name"], a["name"]), 2), first(inside, 3),
        let(F.array_remove(F.split(a["name"], r"\P{Nd}+"), ""), lambda numbers: first(alike(numbers), 4)))


def match_items(items_a: DataFrame, items_b: DataFrame, scope: list[str] = KEYS) -> DataFrame:
    """Match each item of ``items_a`` with one of ``items_b``; four passes, the first hit wins.

    1 equal code, 2 equal name, 3 one name contains the other, 4 alike names.
    Both inputs hold (scope, item_code, description, quantity), the
    second also ``ord``; within a pass its first item by ``ord`` is taken.
    """
    carried = [x for x in items_a.columns if x not in [*scope, *ITEM, "ord"]]
    rows = match_stacked(stacked_items({"a": items_a, "b": items_b.select(*scope, *ITEM, "ord")}), [("a", "b")], scope, carried + ["ord"] * ("ord" in items_a.columns))
    return rows.select(*items_a.columns, "pass", "b_description", "b_quantity")


def match_stacked(items: DataFrame, pairs: list[tuple[str, str]], scope: list[str] = KEYS, carried: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """``match_items`` for several pairs of kinds at once, over items that are told apart by ``kind``.

    Items are shuffled once, by document, and written once: all pairs of a
    document that has at most SMALL_SCOPE items of each kind on average are
    matched where its items lie. Of a larger one no more than that is gathered;
    its items go through joins. Items without ``ord`` are ordered by description
    and code. ``only`` names the documents that are wanted, ``carried`` further
    columns of an item that are handed on.
    """
    carried = carried or []
    ordered = "ord" in items.columns
    kinds = sorted({k for pair in pairs for k in pair})
    limit = SMALL_SCOPE * len(kinds)
    items = items.dropna(subset=scope)
    entry = F.struct(*dict.fromkeys([*ITEM, *carried, *["ord"] * ordered]))
    # a rank within a document, in no order but that of kinds: Spark limits it before the shuffle
    ranked = items.withColumn("_rank", F.row_number().over(Window.partitionBy(*scope).orderBy("kind"))).filter(F.col("_rank") <= limit + 1)
    gathered = ranked.groupBy(*scope).agg(F.max("_rank").alias("_n"), *[F.collect_list(F.when(F.col("kind") == k, entry)).alias(f"of_{k}") for k in kinds])
    if only is not None:
        gathered = gathered.join(only, scope, "left_semi")
    gathered = materialise(gathered, "items-by-document")
    large = gathered.filter(F.col("_n") > limit).select(*scope)

    ready = gathered.filter(F.col("_n") <= limit).select(*scope, *[_prepared(f"of_{k}", ordered).alias(f"of_{k}") for k in kinds])
    ready = ready.select("*", *[_sorted(f"of_{k}").alias(f"in_{k}") for k in sorted({b for _, b in pairs})])
    sides = F.array(*[F.struct(F.lit(i).alias("pair"), F.col(f"of_{a}").alias("lefts"), F.col(f"in_{b}").alias("rights")) for i, (a, b) in enumerate(pairs)])
    paired = ready.select(*scope, F.explode(sides).alias("p")).filter(F.size("p.rights") > 0)
    each = paired.select(*scope, "p.pair", "p.rights", F.explode("p.lefts").alias("a")).filter(F.col("a.name") != "")
    found = each.select(*scope, "pair", *[F.col("a.item")[x].alias(x) for x in [*ITEM, *carried]], "rights", _best(F.col("a"), F.col("rights")).alias("hit"))
    taken = F.get("rights", F.shiftright("hit", 3).cast("int") - 1)
    out = found.select(*scope, "pair", *ITEM, *carried, F.coalesce(F.col("hit") % 8, F.lit(0)).cast("int").alias("pass"), taken["description"].alias("b_description"), taken["quantity"].alias("b_quantity"))
    if large.isEmpty():
        return out

    asked = items if ordered else items.withColumn("ord", _stated_order(F.col("item_code"), F.col("description")))
    asked = materialise(asked.join(large, scope, "left_semi"), "items-of-large-documents")

    def side(at: int) -> DataFrame:
        parts = [asked.filter(F.col("kind") == pair[at]).withColumn("pair", F.lit(i)) for i, pair in enumerate(pairs)]
        return reduce(DataFrame.unionByName, parts)

    return out.unionByName(_match_large(side(0), side(1), [*scope, "pair"]).select(*out.columns))


def _match_large(items_a: DataFrame, items_b: DataFrame, scope: list[str]) -> DataFrame:
    """Items of large documents, by joins.

    Passes 1 and 2 are equi-joins against one row per key.  Passes 3 and 4 see only the
    distinct names that are left, and look up candidates by fragment or rare
    word, so no document's items are compared pairwise.  The result of the
    equi passes is written once, because the later passes read it several times.
    """
    left = items_a.withColumn("_code", _lowered(F.col("item_code"))).withColumn("_name", _lowered(F.col("description"))).filter(F.col("_name") != "")
    right = items_b.withColumn("_code", _lowered(F.col("item_code"))).withColumn("_name", _lowered(F.col("description")))
    item = F.struct("ord", F.col("description").alias("b_description"), F.col("quantity").alias("b_quantity"))
    by_code = right.filter(F.col("_code") != "").groupBy(*scope, "_code").agg(F.min_by(item, "ord").alias("m1"))
    by_name = right.filter(F.col("_name") != "").groupBy(*scope, "_name").agg(F.min_by(item, "ord").alias("m2"))
    equi = materialise(
        left.join(right.select(*scope).distinct(), scope, "left_semi")
        .join(by_code, scope + ["_code"], "left")
        .join(by_name, scope + ["_name"], "left"),
        "items-equal",
    )
    left_names = equi.filter(F.col("m1").isNull() & F.col("m2").isNull()).select(*scope, F.col("_name").alias("name_a")).distinct()
    needed = left_names.select(*scope).distinct()
    right_names = materialise(
        by_name.join(needed, scope, "left_semi").select(*scope, F.col("_name").alias("name_b"), F.col("m2").alias("m")), "items-open")
    names_b = right_names.select(*scope, "name_b")
    a, b = F.col("name_a"), F.col("name_b")
    inside = contains_join(left_names, names_b, "name_a", "name_b", scope).withColumn("pass", F.lit(3))
    words_a = left_names.withColumn("tokens", F.array_distinct(split_words(a)))
    words_b = names_b.withColumn("tokens", F.array_distinct(split_words(b)))
    alike = share_at_least(words_a, words_b, "name_a", "name_b", 0.8, scope, of_larger=True).filter(match.names_alike(a, b)).select(
        *scope, "name_a", "name_b").withColumn("pass", F.lit(4))
    loose = (
        inside.unionByName(alike).join(right_names, scope + ["name_b"])
        .groupBy(*scope, "name_a").agg(F.min_by(F.struct("pass", "m"), F.struct("pass", F.col("m.ord"))).alias("m3"))
        .withColumnRenamed("name_a", "_name")
    )
    found = equi.join(loose, scope + ["_name"], "left")
    hit = F.coalesce("m1", "m2", "m3.m")
    step = F.when(F.col("m1").isNotNull(), 1).when(F.col("m2").isNotNull(), 2).otherwise(F.coalesce("m3.pass", F.lit(0)))
    return found.select(*items_a.columns, step.alias("pass"), hit["b_description"].alias("b_description"), hit["b_quantity"].alias("b_quantity"))


def item_result(name_a: str, name_b: str, seq: int) -> Column:
    """Match result of one matched or missing item row of :func:`match_items`."""
    when, fields = item_fields(F.lit(name_a), F.lit(name_b), F.lit(seq))
    return F.when(when, F.struct(*fields))


def item_fields(name_a: Column, name_b: Column, seq: Column) -> tuple[Column, list[Column]]:
    """Whether an item row has a result, and its fields."""
    d, q, bq = F.col("description"), F.col("quantity"), F.col("b_quantity")
    diff = F.abs(q - bq)
    missing = F.col("pass") == 0
    counted = ~missing & diff.isNotNull()
    tier = F.when(missing, "warning").when(diff < 0.01, "ok").when(diff >= 2, "critical").otherwise("warning")
    off = counted & (diff >= 0.01)
    message = (
        F.when(missing, text_of("Item not found: '", d, "' present in ", name_a, " but missing from ", name_b))
        .when(diff < 0.01, text_of("Item matches: '", d, "' (", name_a, " vs ", name_b, ")"))
        .otherwise(text_of("Quantity discrepancy: '", d, "' — ", name_a, ": ", general(q), ", ", name_b, ": ", general(bq), " (diff: ", general(diff), ")"))
    )
    return missing | counted, result_fields(
        seq, F.when(missing, "missing").when(diff < 0.01, "match").otherwise("mismatch"), tier, message,
        F.when(off, "quantity").otherwise("line_item"), F.when(off, q), F.when(off, bq), actual_str=F.when(missing, d),
        source_a=F.when(missing | off, name_a), source_b=F.when(missing | off, name_b))


def three_way(headers: DataFrame, items: dict[str, DataFrame] | DataFrame) -> DataFrame:
    """Amounts of three pairs, items of three pairs, then the date order; items by kind, or as one table with ``kind``."""
    cols = set(headers.columns)
    out = explode_results(
        headers,
        [levelled_amounts(a, b, i, cols) for i, (a, b) in enumerate(PAIRS)]
        + [date_result(F.col("invoice_date"), F.col("purchase_order_date"), 6)])
    trio = headers.select(*KEYS)
    return out.unionByName(item_results(items, trio))


def item_results(items: dict[str, DataFrame] | DataFrame, trio: DataFrame) -> DataFrame:
    """Item comparisons of the three pairs for the documents of ``trio``, matched together."""
    stacked = items if isinstance(items, DataFrame) else stacked_items(items)
    rows = match_stacked(stacked, PAIRS, KEYS, only=trio)
    name_a, name_b = (F.element_at(F.array(*[F.lit(p[at]) for p in PAIRS]), F.col("pair") + 1) for at in (0, 1))
    when, fields = item_fields(name_a, name_b, F.lit(3) + F.col("pair"))
    return rows.where(when).select(*KEYS, *fields)


def roll_up(results: DataFrame, keys: list[str]) -> DataFrame:
    s = F.col("severity")
    out = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_checks"), F.count_if(s == "ok").alias("ok_count"), F.count_if(s == "warning").alias("warning_count"),
        F.count_if(s == "critical").alias("critical_count"), F.count_if(F.col("status") == "missing").alias("missing_count"))
    return out.withColumn("overall_status", F.when(F.col("critical_count") > 0, "critical").when(F.col("warning_count") > 0, "warning")
                          .when(F.col("missing_count") > 0, "missing").otherwise("ok"))


def match_findings(results: DataFrame, keys: list[str]) -> DataFrame:
    """Non-ok results as findings, the first per message."""
    bad = results.filter(F.col("severity") != "ok")
    first = bad.groupBy(*keys, "message").agg(F.min_by("severity", "seq").alias("tier"))
    critical = F.col("tier") == "critical"
    return first.select(
        *keys, F.col("message").alias("description"), F.when(critical, "high").otherwise("medium").alias("severity"),
        F.when(critical, "Critical discrepancy across documents").otherwise("Warning-level discrepancy").alias("rationale"),
        F.lit("cross_check").alias("kind"), F.lit("compare_three_way").alias("source_check_id"))


def long_fields(df: DataFrame, keys: list[str], fields: list[str], value: str) -> DataFrame:
    """Wide payload to (key, field, value); ``_`` fields are bookkeeping and left out."""
    kept = [f for f in fields if not f.startswith("_")]
    return df.select(*keys, *[F.col(f).cast("string").alias(f) for f in kept]).unpivot(keys, kept, "field_name", value)


def diff_documents(a: DataFrame, b: DataFrame, keys: list[str], nested: list[str] | None = None) -> DataFrame:
    """Field-by-field difference of two long payloads (value_a, value_b)."""
    both = a.join(b, keys + ["field_name"], "full_outer")
    va, vb, f = F.col("value_a"), F.col("value_b"), F.col("field_name")
    na, nb = F.col("num_a"), F.col("num_b")
    both = both.withColumn("num_a", numbers.coerce_number(va)).withColumn("num_b", numbers.coerce_number(vb))
    numeric = na.isNotNull() & nb.isNotNull()
    one = va.isNull() | vb.isNull()
    same = F.lower(strip(va)) == F.lower(strip(vb))
    is_nested = f.isin(nested) if nested else F.lit(False)
    rows = F.when(va.isNull() & vb.isNull(), F.lit(None)).when(
        one, result(F.lit(True), 0, "missing", "warning", text_of("'", f, "' missing from one of the documents"), f, expected_str=va, actual_str=vb)
    ).when(numeric, amount_result(f, na, nb, 0, "A", "B")).when(is_nested, F.lit(None)).when(
        same, result(F.lit(True), 0, "match", "ok", text_of("'", f, "' matches"), f)
    ).otherwise(result(F.lit(True), 0, "mismatch", "warning", text_of("'", f, "' differs: '", va, "' vs '", vb, "'"), f, expected_str=va, actual_str=vb))
    return explode_results(both, [rows], keys)


# --- two documents by request -------------------------------------------------------

def compare_requests(requests: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Compare the two documents of each request, three-way where the third of their trio is in the package.

    ``requests``: request_id, package_id, file_a, file_b.  ``docs``: package_id, file_name, doc_ord, doc_type, fields
    (map of the payload's text fields), total_gross, total_net, amount, date.  ``items``: package_id, file_name,
    item_code, description, quantity, ord.  Two documents of different trio types whose package has one of the third type
    (the first by doc_ord) are matched with it; all others are compared field by field, over the union of their fields.
    Result: request_id, mode (three_way or two_documents), third_file and the match results.  A request one of whose
    files is unknown gives one row, of mode not_found.
    """
    known = docs.select("package_id", "file_name", "doc_type")
    asked = requests.select("request_id", "package_id", "file_a", "file_b")
    for side in ("a", "b"):
        asked = asked.join(known.select("package_id", F.col("file_name").alias(f"file_{side}"), F.col("doc_type").alias(f"type_{side}")), ["package_id", f"file_{side}"], "left")
    trio = [F.coalesce(F.col(f"type_{s}").isin(K.TRIO_TYPES), F.lit(False)) for s in ("a", "b")]
    pair = trio[0] & trio[1] & (F.col("type_a") != F.col("type_b"))
    found = F.col("type_a").isNotNull() & F.col("type_b").isNotNull()
    placed = third_document(asked, docs).withColumn("third_file", F.when(pair, F.col("third_file")))
    placed = materialise(placed.withColumn("mode", F.when(~found, "not_found").when(F.col("third_file").isNotNull(), "three_way").otherwise("two_documents")), "requests")
    empty = placed.where("mode = 'not_found'").select("request_id", "mode", "third_file")
    sides = placed.select("request_id", "package_id", "mode", F.explode(F.array_compact(F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(file).alias("file_name")) for side, file in (("a", "file_a"), ("b", "file_b"), ("third", "third_file"))]))).alias("x"))
    sides = sides.select("request_id", "package_id", "mode", "x.*").where("file_name is not null")

    # three documents: one row of headers for each request, keyed like a package of its own
    three = sides.where("mode = 'three_way'")
    read = three.join(docs, ["package_id", "file_name"])
    value = F.struct("total_gross", "total_net", "amount", "date")
    heads = read.groupBy("package_id", F.col("request_id").alias("doc_id")).agg(*[F.first(F.when(F.col("doc_type") == k, value), ignorenulls=True).alias(k) for k in K.TRIO_TYPES])
    headers = heads.select(*KEYS, *[F.col(f"{k}.{f}").alias(f"{k}_{f}") for k in K.TRIO_TYPES for f in ("total_gross", "total_net", "amount", "date")])
    own = three.join(items, ["package_id", "file_name"]).join(known, ["package_id", "file_name"]).withColumn("doc_id", F.col("request_id"))
    columns = [*KEYS, "item_code", "description", "quantity", "ord"]
    matched = three_way(headers, {k: own.where(F.col("doc_type") == k).select(*columns) for k in K.TRIO_TYPES})

    # two documents: their fields side by side
    two = sides.where("mode = 'two_documents'").join(docs.select("package_id", "file_name", "fields"), ["package_id", "file_name"])
    long = two.select("package_id", F.col("request_id").alias("doc_id"), "side", F.explode("fields").alias("field_name", "value")).where(~F.col("field_name").startswith("_"))
    a, b = (long.where(F.col("side") == side).select(*KEYS, "field_name", F.col("value").alias(f"value_{side}")) for side in ("a", "b"))
    differing = diff_documents(a, b, KEYS)

    results = matched.unionByName(differing).withColumnRenamed("doc_id", "request_id").drop("package_id")
    return placed.select("request_id", "mode", "third_file").join(results, "request_id").unionByName(empty, allowMissingColumns=True)
