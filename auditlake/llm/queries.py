"""Named queries over the operators of this subpackage, and the check texts of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import bpe, chat, decontaminate, jaccard, licenses, lines, merkle, quality, repair, secrets, simhash, tokens, urls
from auditlake.llm.common import table
from auditlake.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_bpe")
def op2_bpe(spark, path):
    done = bpe.encode_decode(table(spark, path, "documents"), vocabulary("byte_bpe_50k.json"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_decontaminate")
def op8_decontaminate(spark, path):
    found = decontaminate.occurrences(table(spark, path, "documents"), table(spark, path, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@query("op1_simhash")
def op1_simhash(spark, path):
    found = simhash.classes(table(spark, path, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


#: ASCII white space at both ends removed and A-Z in lower case, in check texts.
KEY_SQL = r"translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINES_SQL = f"""
with rows as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
keyed as (select doc_id, pos, line, {KEY_SQL} as key from rows),
held as (select key, count(distinct doc_id) as n, max(doc_id) as last from keyed where length(key) >= 20 group by key),
judged as (select k.*, coalesce(h.n >= 3 and k.doc_id < h.last, false) as gone from keyed k left join held h on k.key = h.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""


@query("op5_lines", LINES_SQL)
def op5_lines(spark, path):
    left = lines.drop_repeats(table(spark, path, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


CHAT_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 1, 'user', '</s>[INST] ok [/INST]'), (-7, 2, 'assistant', '</s>[INST] ok [/INST]')),
clash as (
  select *, contains(role || chr(0) || text, '[INST]') or contains(role || chr(0) || text, '[/INST]') or contains(role || chr(0) || text, '</s>')
    or regexp_matches(role || chr(0) || text, '\\[bsl]') as escaped from rows),
sized as (
  select *, 17 + length(role) + length(text)
    + case when escaped then length(role || text) - length(translate(role || text, '\[<', '')) else 0 end as chars from clash)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(chars) as formatted_chars
from sized group by conv_id
"""


@query("op10_chat", CHAT_SQL)
def op10_chat(spark, path):
    clash = chat.END + chat.OPEN + " ok " + chat.CLOSE
    chats = table(spark, path, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(1, 3).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 1, "user").otherwise(chat.ASSISTANT).alias("role"), F.lit(clash).alias("text"))
    back = chat.read_back(chat.format_chats(chats.unionByName(added)))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op9_quality")
def op9_quality(spark, path):
    counted = materialise(quality.features(table(spark, path, "documents").select("doc_id", "text")).drop("text"), "features")
    judged = quality.verdicts(counted, quality.fit(counted))
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *[F.col("_f")[c].alias(c) for c in shown], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_quality").alias("quality"))


@query("op7_licenses")
def op7_licenses(spark, path):
    found = licenses.scan(table(spark, path, "documents"))
    base, more = F.col("base"), F.col("found")
    sure = F.transform(base, lambda b: b["label"])
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda b: b["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda b: b["word"])).alias("last_word"),
        listed(sure).alias("base_labels"),
        listed(F.concat(sure, F.transform(more, lambda d: d["label"]))).alias("labels"),
        F.greatest(F.when(F.size(base) > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform(more, lambda d: d["score"])), F.lit(0.0))).alias("score"),
    )


@query("op6_secrets")
def op6_secrets(spark, path):
    found = secrets.scan(table(spark, path, "documents"))
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in secrets.LEAST], F.sha2(listed(F.filter(spans, lambda s: s["cost"].isNull())), 256).alias("base_sha256"), listed(spans).alias("spans"))


@query("op3_tokens")
def op3_tokens(spark, path):
    return tokens.token_counts(table(spark, path, "documents"), vocabulary("piece_bpe_32k.model"))


URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]

URL_SQL = r"""
with cut as (select page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') as rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from cut),
rules(rule, h, p, action) as (values ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
fits as (
  select page_id, max_by(rule, length(rule)) as rule, max_by(action, length(rule)) as action
  from parts, rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') as verdict from parts p left join fits f on p.page_id = f.page_id
"""


@query("op4_urls", URL_SQL)
def op4_urls(spark, path):
    return urls.judge(table(spark, path, "pages"), spark.createDataFrame(URL_RULES, "rule string, action string"))


#: Unsigned CRC-32 of an ASCII text, in check texts: eight steps of the reversed polynomial for each byte.
CRC_SQL = "xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: ord(({0})[i])::bigint), lambda c, b: list_reduce(range(8), lambda v, k: xor(v >> 1, (v & 1) * 3988292384), xor(c, b)), 4294967295::bigint), 4294967295)"


def _leaf_sql(n_chars: str) -> str:
    fields = ["doc_id", "source", "lang", n_chars, "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen(({f})::varchar) || ':' || ({f})::varchar, '-')" for f in fields) + ")"


MERKLE_SQL = f"""
with recursive given as (
  select *, {_leaf_sql("n_chars")} as leaf,
    {CRC_SQL.format("doc_id::varchar")} % 7 = 0 as touched, {_leaf_sql("n_chars + 1")} as other from documents),
leaves as (
  select doc_id, leaf, case when touched and n_chars is not null then other else leaf end as claim,
    dense_rank() over (order by lang nulls first) - 1 as tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos,
    count(*) over (partition by lang) as n from given),
up as (
  select tree, 0 as level, pos, leaf as node, n from leaves
  union all
  select tree, level + 1, pos // 2, sha256(string_agg(node, '' order by pos)), (n + 1) // 2 from up where n > 1 group by tree, level, pos // 2, n),
tops as (select tree, node as subroot, level as depth from up where n = 1),
high as (
  select 0 as level, tree as pos, subroot as node, (select count(*) from tops) as n from tops
  union all
  select level + 1, pos // 2, sha256(string_agg(node, '' order by pos)), (n + 1) // 2 from high where n > 1 group by level, pos // 2, n),
steps as (
  select l.doc_id, l.pos, l.tree, u.level, u.node as beside, (u.pos & 1) = 0 as before
  from leaves l join tops t on t.tree = l.tree cross join range(64) g(level) join up u on u.tree = l.tree and u.level = g.level and u.pos = xor(l.pos >> g.level::int, 1)
  where g.level < t.depth
  union all
  select l.doc_id, l.pos, l.tree, t.depth + g.level, h.node, (h.pos & 1) = 0
  from leaves l join tops t on t.tree = l.tree cross join range(64) g(level) join high h on h.level = g.level and h.pos = xor(l.tree >> g.level::int, 1)
  where g.level < (select max(level) from high)),
ways as (select pos, tree, coalesce(string_agg(beside, '' order by level), '') as way from steps group by pos, tree),
walk as (
  select tree, pos, 0 as level, claim as node from leaves
  union all
  select w.tree, w.pos, w.level + 1, sha256(case when s.before then s.beside || w.node else w.node || coalesce(s.beside, '') end)
  from walk w join tops t on t.tree = w.tree and w.level < t.depth + (select max(level) from high) left join steps s on s.tree = w.tree and s.pos = w.pos and s.level = w.level),
ends as (select tree, pos, max_by(node, level) as folded_root from walk group by tree, pos)
select l.doc_id, l.leaf, t.subroot, (select node from high where n = 1) as root, sha256(coalesce(w.way, '')) as proof_sha256,
  e.folded_root, e.folded_root = (select node from high where n = 1) as verified
from leaves l join tops t on t.tree = l.tree join ends e on e.tree = l.tree and e.pos = l.pos left join ways w on w.tree = l.tree and w.pos = l.pos
"""


@query("op11_merkle", MERKLE_SQL)
def op11_merkle(spark, path):
    docs = table(spark, path, "documents").select(*merkle.FIELDS)
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    claim = F.when(touched, merkle.leaf_digest([F.try_add(f, F.lit(1)) if f == "n_chars" else F.col(f) for f in merkle.FIELDS]))
    found = merkle.manifest(docs, claim).withColumn("claim", F.coalesce("claim", "leaf"))
    return merkle.verify(found, "claim").select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), "folded_root", "verified")


DAMAGE_SQL = f"""
keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as id from conversations),
drawn as (select *, {CRC_SQL.format("id")} % 20 as draw from keyed),
damaged as (
  select conv_id, turn, case when draw = 4 then 'user' else role end as role,
    case when draw = 1 then '' when draw = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when draw = 0 then 0 when draw = 3 then 2 else 1 end)) as copy from drawn)
"""

REPAIR_SQL = rf"""
with recursive {DAMAGE_SQL.strip()},
ordered as (select *, row_number() over (partition by conv_id order by turn nulls first, sha256(role || chr(0) || text), copy) as i from damaged),
placed as (
  select *, left(role, 1) as initial, row_number() over (partition by conv_id, role, text order by i) > 1 as seen, regexp_replace(text, '[\x20\x09-\x0D]+$', '') as bare from ordered),
faulty as (
  select *, case when bare = '' then 'blank' when seen then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(initial) over (partition by conv_id order by i) || initial not in ('su', 'ua', 'au') as bad from placed),
p(state, added, made) as (values (0, [], 0), (0, ['user:'], 2), (0, ['user:', 'assistant:'], 3), (1, [], 1), (1, ['user:'], 2), (1, ['user:', 'assistant:'], 3), (2, [], 2), (2, ['assistant:'], 3), (3, [], 3), (3, ['user:'], 2)),
q(state, letter, initial, paid, made) as (values (0, 'D', null, 2, 0), (1, 'D', null, 2, 1), (2, 'D', null, 2, 2), (3, 'D', null, 2, 3), (0, 'K', 's', 0, 1), (0, 'K', 'u', 0, 2), (1, 'K', 'u', 0, 2), (3, 'K', 'u', 0, 2), (2, 'K', 'a', 0, 3),
  (0, 'R', null, 1, 2), (1, 'R', null, 1, 2), (3, 'R', null, 1, 2), (2, 'R', null, 1, 3)),
walk as (
  select conv_id, 0::bigint as i, 0 as state, {{'cost': 0::bigint, 'audit': '', 'turns': []::varchar[]}} as way from (select distinct conv_id from conversations)
  union all
  select w.conv_id, w.i + 1, q.made, min({{'cost': w.way.cost + 5 * len(p.added) + q.paid + case when q.letter <> 'D' and r.fault = 'truncated' then 5 else 0 end,
    'audit': w.way.audit || repeat('I', len(p.added)::bigint) || q.letter,
    'turns': w.way.turns || p.added::varchar[] || case q.letter when 'D' then []::varchar[] when 'K' then [r.role || ':' || r.text] else [case q.made when 2 then 'user:' else 'assistant:' end || r.text] end}})
  from walk w join faulty r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1 join p on p.state = w.state
    join q on q.state = p.made and (q.letter = 'D' or (r.fault not in ('blank', 'duplicate') and (q.letter = 'R' or q.initial = r.initial)))
  group by w.conv_id, w.i, q.made),
ends as (
  select w.conv_id, min({{'cost': way.cost + 5 * len(p.added), 'audit': way.audit || repeat('I', len(p.added)::bigint), 'turns': way.turns || p.added::varchar[]}}) as way
  from walk w join p on p.state = w.state and p.made in (0, 3) where w.i = (select count(*) from damaged d where d.conv_id is not distinct from w.conv_id) group by w.conv_id),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
    count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where bad) as illegal from faulty group by conv_id)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  e.way.cost as cost, e.way.audit as audit, sha256(array_to_string(e.way.turns, chr(10))) as repaired_sha256
from ends e left join counted c on c.conv_id is not distinct from e.conv_id
"""


@query("op13_repair", REPAIR_SQL)
def op13_repair(spark, path):
    given = table(spark, path, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    drawn = given.withColumn("draw", F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20)
    draw = F.col("draw")
    copies = F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1)
    damaged = drawn.select(
        "conv_id",
        "turn",
        F.when(draw == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.translate("text", repair.ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"),
    )
    planned = materialise(repair.plans(damaged), "plans")
    hashed = repair.digests(repair.repaired(damaged, planned)).select(F.col("conv_id").alias("hashed"), F.col("sha256").alias("repaired_sha256"))
    every = given.select(F.col("conv_id").alias("given")).distinct()
    found = every.join(planned, F.col("given").eqNullSafe(F.col("conv_id")), "left").join(hashed, F.col("given").eqNullSafe(F.col("hashed")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("given").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


JACCARD_SQL = r"""
with recursive folded as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingled as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) end) as s from folded),
sized as (select doc_id, len(s) as n, s from shingled),
flat as (select doc_id, n, unnest(s) as token from sized),
shared as (select a.doc_id as x, b.doc_id as y, any_value(a.n) as nx, any_value(b.n) as ny, count(*) as hits from flat a join flat b on a.token = b.token and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as (select x, y from shared where 100 * hits >= 80 * (nx + ny - hits)),
reach as (select doc_id, doc_id as other from sized union select r.doc_id, l.y from reach r join links l on l.x = r.other)
select s.doc_id, s.n as n_shingles, min(r.other) as component_id from sized s join reach r on r.doc_id = s.doc_id group by s.doc_id, s.n
"""


@query("op12_jaccard", JACCARD_SQL)
def op12_jaccard(spark, path):
    return jaccard.classes(table(spark, path, "documents"))
