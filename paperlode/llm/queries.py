"""The queries of these operators and, where SQL can say it, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.llm import bpe, centroids, codes, leaks, licenses, mixing, quality
from paperlode.llm import shards, simhash, suffixes, toxicity, urls, vectors
from paperlode.session import settle

WORDS_SQL = r"[x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> '']"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op1_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    learned = labels.filter(~held_out).withColumnRenamed("toxic", "y")
    scored = toxicity.score(docs, toxicity.fit(*toxicity.training_sample(docs, learned)))
    return scored.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    measured = settle(quality.measure(docs).drop("text"), "measured")
    return quality.apply_rules(measured).select(
        "doc_id", *quality.MEASURES, "base_failed", "host_rejected", "kept"
    )


MEASURED_SQL = rf"""
tokens as (select doc_id, source, coalesce(text, '') as body, {WORDS_SQL} as w,
  [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')]
    as lines from documents),
places as (
  select doc_id, unnest(w) as a, generate_subscripts(w, 1) as i from tokens where len(w) > 2
),
windows as (
  select doc_id, i, a, lead(a) over d as b, lead(a, 2) over d as c from places
  window d as (partition by doc_id order by i)
),
twice as (
  select doc_id, i, count(*) over (partition by doc_id, a, b, c) as k from windows
  where c is not null
),
repeats as (
  select doc_id, count(distinct j) as n from (
    select doc_id, unnest([i, i + 1, i + 2]) as j from twice where k > 1
  ) group by doc_id
),
measured as (
  select t.doc_id, t.source, len(w) as n_words,
    length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(n, 0) as n_repeat_words
  from tokens t left join repeats r on t.doc_id = r.doc_id
),
judged as (
  select *, n_words < 50 as short, 100 * n_repeat_words > 50 * n_words as repetitive,
    10 * n_symbols > 5 * n_words as symbols
  from measured
),
failures as (
  select source, rule, count(*) as docs, sum(failed::bigint) as fails from (
    select source, unnest(['short', 'repetitive', 'symbols']) as rule,
      unnest([short, repetitive, symbols]) as failed from judged
  ) group by source, rule
),
overall as (
  select rule, sum(fails) / sum(docs) as mean from failures group by rule
),
prior as (
  select rule, mean, case when v > 0 then greatest(mean * (1 - mean) / v - 1, 1.0) else 1e6 end
    as weight
  from (
    select f.rule, any_value(mean) as mean, avg((fails / docs - mean) ** 2) as v
    from failures f join overall o on f.rule = o.rule group by f.rule
  )
),
hosts as (
  select source, max((fails + mean * weight) / (docs + weight)) >= {quality.HOST_RATE}
    as host_rejected
  from failures f join prior p on f.rule = p.rule group by source
)"""

OP2_SQL = f"""with {MEASURED_SQL}
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars,
  n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, short or repetitive as base_failed, host_rejected,
  not (short or repetitive) and not host_rejected as kept
from judged j join hosts h on j.source is not distinct from h.source"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffixes.remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))
    runs = F.transform("removed", lambda r: r["end"] - r["start"])
    return cleaned.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate(runs, F.lit(0).cast("long"), lambda total, n: total + n).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


#: Dealing in rounds ends where every source has the lesser of its cap and its share of a level;
#: the level follows from the order of caps by weight.
OP4_SQL = rf"""with sized as (
  select doc_id, source, len({WORDS_SQL})::bigint as size,
    md5('0:' || coalesce(doc_id::varchar, '-') || ':' || md5(coalesce(text, ''))) as key
  from documents
),
sources as (
  select source, sum(size)::bigint as source_size,
    ([5.0, 2.0, 1.0])[1 + (row_number() over (order by source nulls last) - 1) % 3]::double as w
  from sized group by source
),
levels as (
  select *, 2.0 * source_size / w as ratio, sum(source_size) over () * 1.5 as total,
    coalesce(sum(2.0 * source_size) over (order by 2.0 * source_size / w, source
      rows between unbounded preceding and 1 preceding), 0) as capped,
    sum(w) over (order by 2.0 * source_size / w, source
      rows between current row and unbounded following) as open
  from sources
),
level as (
  select arg_min((total - capped) / open, ratio) filter ((total - capped) / open <= ratio) as level
  from levels
),
goals as (
  select source, source_size, least(2.0 * source_size, w * level) as target from levels, level
),
ordered as (
  select s.*, g.source_size, g.target,
    coalesce(sum(size) over (partition by s.source order by key
      rows between unbounded preceding and 1 preceding), 0) as earlier
  from sized s join goals g on s.source is not distinct from g.source
)
select doc_id, size, source_size, target,
  (case when source_size > 0 then floor(floor(target) / source_size) * size
    + greatest(0, least(size, floor(target) - floor(floor(target) / source_size) * source_size
      - earlier)) else 0 end)::bigint as taken
from ordered"""

URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op8_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    return urls.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def _fits(key: str) -> str:
    host, path = key.split("/", 1)
    return f"('.' || host like '%.{host}' and path like '/{path}%')"


OP8_SQL = rf"""with parts as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages
),
ruled as (
  select *, case {" ".join(f"when {_fits(k)} then '{k}'" for k in sorted((k for _, k in URL_RULES), key=len, reverse=True))} end as rule
  from parts
)
select page_id, host, path, rule,
  case when rule in ({", ".join(f"'{k}'" for a, k in URL_RULES if a == "block")}) then 'block' else 'allow' end as verdict
from ruled"""


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    body = F.coalesce("text", F.lit(""))
    thin = docs.select(
        "doc_id",
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    rows = shards.shard_rows(thin, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_license_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a file tree: a directory for each thousand, hundred and ten of ids. Ids
    divisible by 10, 100 and 1,000 are the licence files of these directories."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    n = F.col("doc_id")
    dirs = [(n / k).cast("long").cast("string") for k in (1000, 100, 10)]
    depth = F.when(n % 1000 == 0, 1).when(n % 100 == 0, 2).otherwise(3)
    name = F.when(n % 10 == 0, F.concat(F.lit("LICENSE-"), n)).otherwise(F.concat(F.lit("file-"), n))
    path = F.concat_ws("/", F.slice(F.array(*dirs), F.lit(1), depth), F.array(name))
    files = docs.select("doc_id", "text", F.when(n.isNotNull(), path).alias("path"))
    return licenses.scan(files).select(
        "doc_id", "path", "license", F.round("cosine", 6).alias("cosine"), "origin", "license_dir"
    )


def op6_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    prints = docs.select("doc_id", simhash.fingerprints(F.col("text")).alias("prints"))
    classes = simhash.near_classes(settle(prints, "prints"))
    return classes.select(
        "doc_id", simhash.hex_of(F.col("prints")[0]).alias("fingerprint"), "component_id"
    )


def op7_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return vectors.search(rows, F.col("vec_id") % 20 == 0)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(read(spark, sf_dir, "documents", "doc_id", "text"))
    return encoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids")), 256).alias("decoded_sha256"),
    )


def op11_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = leaks.find_leaks(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(leaks.listing(F.col("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _leak_words(table: str, key: str) -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cut = rf"regexp_split_to_array({lower}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"select {key}, [x for x in coalesce({cut}, []) if x <> ''] as w from {table}"


def _runs(name: str, key: str) -> str:
    return f"""select {key}, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as gram
  from (select {key}, w, n, unnest(range(1, (len(w) - n + 2)::bigint)) as i from {name}, lengths)"""


OP11_SQL = f"""with docs as ({_leak_words("documents", "doc_id")}),
items as ({_leak_words("benchmark", "item_id")}),
lengths as (select distinct least(10, len(w)) as n from items where len(w) > 0),
windows as (
  select distinct item_id, n, gram from ({_runs("items", "item_id")})
  join (select item_id as own, least(10, len(w)) as own_n from items) on item_id = own and n = own_n
),
hits as (
  select doc_id, d.n, i, item_id
  from ({_runs("docs", "doc_id")}) d join windows x on d.n = x.n and d.gram = x.gram
),
covered as (
  select doc_id, count(distinct j) as n_hit
  from (select doc_id, unnest(range(i, i + n)) as j from hits) group by doc_id
),
listed as (
  select doc_id, count(*) as n_items,
    sha256(string_agg(item_id::varchar, ',' order by item_id::varchar)) as items_sha256
  from (select distinct doc_id, item_id from hits) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from docs d left join covered c on d.doc_id = c.doc_id left join listed l on d.doc_id = l.doc_id"""

def op12_threshold_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centres = centroids.cluster(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return centroids.with_inertia(rows.drop("embedding"), centres)


#: Vectors as whole numbers, and the squared distance of two lists.
def _whole(scale: int, keep: str) -> str:
    return f"""kept as materialized (
  select *, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0{keep}
)"""


SQUARED = "list_sum(list_transform(list_zip(v, e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
#: Exact floor of a quotient of whole numbers; the divisor is above 0.
FLOORED = "((s - ((s % n) + n) % n) // n)::bigint"


def _clusters_sql(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64) -> str:
    steps = [
        _whole(scale, f" and len(embedding) = {size}"),
        f"""c0 as materialized (
  select row_number() over (order by name, vec_id) - 1 as c, v as e
  from (select *, sha256('1:' || vec_id::varchar) as name from kept)
  qualify row_number() over (order by name, vec_id) <= {k}
)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""near{r} as materialized (
  select vec_id, any_value(v) as v, min(d) as distance, arg_min(c, d * {k} + c) as c
  from (select vec_id, v, c, {SQUARED} as d from kept, c{r}) group by vec_id
)""")
        steps.append(f"""c{r + 1} as materialized (
  select o.c, coalesce(f.e, o.e) as e from c{r} o left join (
    select c, list({FLOORED} order by j) as e from (
      select c, j, sum(x) as s, count(*) as n
      from (select c, unnest(v) as x, unnest(range(1, {size + 1})) as j from near{r}) group by c, j
    ) group by c
  ) f on o.c = f.c
)""")
    return f"""with {", ".join(steps)}
select vec_id, near{rounds}.c::int as cluster, distance,
  (sum(distance) over (partition by near{rounds}.c))::bigint as cluster_inertia,
  (sum(distance) over ())::bigint as inertia, sha256(array_to_string(e, ',')) as centroid_sha256
from near{rounds} join c{rounds} on near{rounds}.c = c{rounds}.c"""


OP12_SQL = _clusters_sql()


def op13_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codes.compress(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    rows = codes.with_label_error(found.rows.drop("embedding"), "label")
    return rows.select(
        "vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256")
    )


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    steps = [
        _whole(scale, ""),
        f"""parts as materialized (
  select vec_id, label, p, list_slice(v, p * w + 1, p * w + w) as v
  from (select *, len(v) // {parts} as w, unnest(range(0, {parts})) as p from kept)
)""",
        f"""c0 as materialized (
  select p, row_number() over (partition by p order by vec_id) - 1 as c, v as e from parts
  qualify row_number() over (partition by p order by vec_id) <= {entries}
)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""near{r} as materialized (
  select vec_id, p, any_value(label) as label, any_value(v) as v, min(d) as error,
    arg_min(c, d * {entries} + c) as c
  from (select vec_id, label, t.p, v, c, {SQUARED} as d from parts t join c{r} on t.p = c{r}.p)
  group by vec_id, p
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} as materialized (
  select o.p, o.c, coalesce(f.e, o.e) as e from c{r} o left join (
    select p, c, list({FLOORED} order by j) as e from (
      select p, c, j, sum(x) as s, count(*) as n
      from (select p, c, unnest(v) as x, unnest(range(1, len(v) + 1)) as j from near{r}) group by p, c, j
    ) group by p, c
  ) f on o.p = f.p and o.c = f.c
)""")
    return f"""with {", ".join(steps)},
books as (
  select sha256(string_agg(array_to_string(e, ','), ',' order by p, c)) as codebooks_sha256 from c{rounds}
),
coded as (
  select vec_id, any_value(label) as label, sum(error)::bigint as error,
    string_agg(lower(printf('%02x', c)), '' order by p) as code from near{rounds} group by vec_id
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from coded, books"""


OP13_SQL = _codes_sql()

QUERIES = {
    "op1_string_kernel": op1_string_kernel,
    "op2_host_rules": op2_host_rules,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_mix": op4_mix,
    "op5_license_tree": op5_license_tree,
    "op6_simhash_anchors": op6_simhash_anchors,
    "op7_dimension_scan": op7_dimension_scan,
    "op8_url_cascade": op8_url_cascade,
    "op9_feistel_shards": op9_feistel_shards,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_benchmark_leaks": op11_benchmark_leaks,
    "op12_threshold_clusters": op12_threshold_clusters,
    "op13_product_codes": op13_product_codes,
}
ORACLES = {
    "op2_host_rules": OP2_SQL,
    "op4_mix": OP4_SQL,
    "op8_url_cascade": OP8_SQL,
    "op11_benchmark_leaks": OP11_SQL,
    "op12_threshold_clusters": OP12_SQL,
    "op13_product_codes": OP13_SQL,
}
