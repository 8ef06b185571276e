"""URL filters by a path-template tree. DataFrame functions only.

Explicit rules come first: (host, path prefix) pairs that hold for the host and its
subdomains; the longest that fits decides. URLs under a rule are the labelled ones.
The rest is judged by templates. Runs of digits and long hexadecimal runs in a path
become wildcards, which gives each host's leaves with their page and label counts.
Then, segment by segment, a branch becomes a wildcard if it is one of many small ones
(a variable segment), or if its share of blocked pages is statistically like that of
all its siblings together (similar branches merge). A template's purity is its blocked
share, smoothed towards the same template on all hosts and then towards the whole;
templates above ``MAX_PURITY`` are rejected.

The path of a host with no other leaf of as many segments is a chain with one child at
every level: it meets no sibling, so its template is known without a walk (labelled ones merge
with themselves, wildcard by wildcard; others stay). Of a longer path, what follows segment
``LEVELS - 1`` counts as one last segment, so no URL makes the walk longer than ``LEVELS``.

All joins are between tables of distinct leaves, made with partial aggregation, so a
host that holds a third of all pages is a few rows before any shuffle.

Cases: a null url or one without ``://`` has an empty host and path; no rule fits
those; with no labelled page everything else is allowed; repeated rows are judged
each; urls of any length are read whole; rules of equal length that fit one url go by their text,
and no other step has ties; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.session_tools import stage, text_input

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule); a rule is a host and a path prefix. Fixed values of the query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Segments that the SQL form covers.
DEPTH = 3
LEVELS = 32
MANY_CHILDREN = 20
FEW_PAGES = 5
Z = 2.0
SLACK = 0.05
PRIOR = 10.0
MAX_PURITY = 0.5


def parsed(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or null."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # a longer one overrides
        h, _, p = text.partition("/")
        fits = ((host == F.lit(h)) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def leaf_of(path: Column) -> Column:
    """The path with long hexadecimal runs and runs of digits as wildcards."""
    return F.regexp_replace(F.regexp_replace(path, r"\b[0-9a-fA-F]{16,}\b", "<h>"), r"[0-9]+", "<n>")


def segments_of(path: str) -> Column:
    """The path's segments after an empty first one; beyond LEVELS the rest is one."""
    return F.split(path, "/", LEVELS + 1)


def masked(template: str, k: int) -> Column:
    """The template with its k-th segment (from 1) as a wildcard; shorter ones stay."""
    return F.concat_ws("/", F.transform(segments_of(template), lambda x, i: F.when(i == F.lit(k), F.lit("*")).otherwise(x)))


def tree(leaves: DataFrame) -> DataFrame:
    """host, leaf, template, pages, labelled, blocked: leaves with generalised and merged templates."""
    segments = F.size(segments_of("leaf")) - 1
    df = stage(leaves.withColumns({"template": F.col("leaf"), "depth": segments}), "url-leaves")
    alike = df.groupBy("host", "depth").agg(F.count(F.lit(1)).alias("m"))
    df = stage(df.join(alike, ["host", "depth"]), "url-leaves")
    chain = F.transform(segments_of("leaf"), lambda x, i: F.when(i == 0, x).otherwise(F.lit("*")))
    columns = ["host", "leaf", "template", "pages", "labelled", "blocked"]
    alone = df.where("m = 1").withColumn("template", F.when(F.col("labelled") > 0, F.concat_ws("/", chain)).otherwise(F.col("leaf")))
    done = [alone.select(columns)]
    df = df.where("m > 1").select(columns)
    deepest = df.agg(F.max(segments)).first()[0] or 0
    for k in range(1, deepest + 1):
        # A template with a wildcard in segment k has that many, so leaves with fewer are as they will be.
        done.append(df.where(segments < k))
        df = df.where(segments >= k).withColumn("above", masked("template", k))
        own = df.groupBy("host", "template").agg(F.sum("labelled").alias("own_n"), F.sum("blocked").alias("own_b"))
        all_ = df.groupBy("host", "above").agg(F.count(F.lit(1)).alias("kids"), F.sum("pages").alias("all_pages"),
                                               F.sum("labelled").alias("all_n"), F.sum("blocked").alias("all_b"))
        df = df.join(own, ["host", "template"]).join(all_, ["host", "above"])
        p, q = F.try_divide("own_b", "own_n"), F.try_divide("all_b", "all_n")
        variable = (F.col("kids") > MANY_CHILDREN) & (F.col("all_pages") < FEW_PAGES * F.col("kids"))
        similar = (F.col("own_n") > 0) & (F.abs(p - q) <= Z * F.sqrt(F.try_divide(q * (1 - q), F.col("own_n"))) + SLACK)
        merges = F.coalesce(variable | similar, F.lit(False))
        df = df.select("host", "leaf", F.when(merges, F.col("above")).otherwise(F.col("template")).alias("template"),
                       "pages", "labelled", "blocked")
        df = stage(df, "url-tree")  # each level is read several times by the next
    return reduce(DataFrame.unionByName, done, df)


def rejected(leaves: DataFrame) -> DataFrame:
    """host, leaf, purity of every leaf."""
    df = tree(leaves)
    whole = df.agg(F.coalesce(F.try_divide(F.sum("blocked"), F.sum("labelled")), F.lit(0.0)).alias("share"))
    across = df.groupBy("template").agg(F.sum("labelled").alias("t_n"), F.sum("blocked").alias("t_b"))
    own = df.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
    prior = (F.col("t_b") + F.lit(PRIOR) * F.col("share")) / (F.col("t_n") + F.lit(PRIOR))
    own = own.join(across, "template").crossJoin(F.broadcast(whole))  # one row
    own = own.select("host", "template", ((F.col("b") + F.lit(PRIOR) * prior) / (F.col("n") + F.lit(PRIOR))).alias("purity"))
    return df.join(own, ["host", "template"]).select("host", "leaf", "template", "purity")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity (the last two null under a rule)."""
    host, path = parsed(F.col("url"))
    df = text_input(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = df.select("*", rule.alias("rule"), verdict.alias("said"), leaf_of(F.col("path")).alias("leaf"))
    leaves = df.groupBy("host", "leaf").agg(F.count(F.lit(1)).alias("pages"), F.count("said").alias("labelled"),
                                            F.count_if(F.col("said") == "block").alias("blocked"))
    # Pages under a rule need no template, and only the rest goes to the join.
    free = df.where(F.col("said").isNull()).join(rejected(leaves), ["host", "leaf"], "left")
    free = free.select("page_id", "host", "path", "rule", F.when(F.col("purity") > MAX_PURITY, "block").otherwise("allow").alias("verdict"),
                       "template", F.round("purity", 6).alias("purity"))
    ruled = df.where(F.col("said").isNotNull()).select("page_id", "host", "path", "rule", F.col("said").alias("verdict"),
                                                       F.lit(None).cast("string").alias("template"), F.lit(None).cast("double").alias("purity"))
    return ruled.unionByName(free)


def oracle(table: str = "pages") -> str:
    """The same result in DuckDB."""
    ordered = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    fits = [(said, text, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')")
            for said, text in ordered for h, _, p in [text.partition("/")]]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{text}'" for _, text, c in fits) + " END"
    said = "CASE " + " ".join(f"WHEN {c} THEN '{said}'" for said, _, c in fits) + " END"
    steps = ""
    for k in range(1, DEPTH + 1):
        above = f"array_to_string(list_transform(string_split(template, '/'), lambda x, i: CASE WHEN i = {k + 1} THEN '*' ELSE x END), '/')"
        steps += f""",
a{k} AS (SELECT *, {above} AS above FROM t{k - 1}),
c{k} AS (SELECT *, sum(labelled) OVER (PARTITION BY host, template) AS own_n, sum(blocked) OVER (PARTITION BY host, template) AS own_b,
  count(*) OVER (PARTITION BY host, above) AS kids, sum(pages) OVER (PARTITION BY host, above) AS all_pages,
  sum(labelled) OVER (PARTITION BY host, above) AS all_n, sum(blocked) OVER (PARTITION BY host, above) AS all_b FROM a{k}),
d{k} AS (SELECT *, own_b::DOUBLE / nullif(own_n, 0) AS p, all_b::DOUBLE / nullif(all_n, 0) AS q FROM c{k}),
t{k} AS (SELECT host, leaf, pages, labelled, blocked, CASE WHEN coalesce((kids > {MANY_CHILDREN} AND all_pages < {FEW_PAGES} * kids)
  OR (own_n > 0 AND abs(p - q) <= {Z}::DOUBLE * sqrt(q * (1 - q) / own_n) + {SLACK}::DOUBLE), false) THEN above ELSE template END AS template FROM d{k})"""
    return f"""
WITH parsed AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM {table}),
split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parsed),
ruled AS (SELECT *, {rule} AS rule, {said} AS said, regexp_replace(regexp_replace(path, '\\b[0-9a-fA-F]{{16,}}\\b', '<h>', 'g'), '[0-9]+', '<n>', 'g') AS leaf FROM split),
t0 AS (SELECT host, leaf, leaf AS template, count(*) AS pages, count(said) AS labelled, count(*) FILTER (WHERE said = 'block') AS blocked FROM ruled GROUP BY host, leaf){steps},
f AS (SELECT * FROM t{DEPTH}),
w AS (SELECT coalesce(sum(blocked)::DOUBLE / nullif(sum(labelled), 0), 0.0) AS share FROM f),
x AS (SELECT template, sum(labelled) AS t_n, sum(blocked) AS t_b FROM f GROUP BY template),
o AS (SELECT host, template, sum(labelled) AS n, sum(blocked) AS b FROM f GROUP BY host, template),
u AS (SELECT o.host, o.template, (b + {PRIOR}::DOUBLE * ((t_b + {PRIOR}::DOUBLE * share) / (t_n + {PRIOR}::DOUBLE))) / (n + {PRIOR}::DOUBLE) AS purity FROM o JOIN x USING (template), w),
l AS (SELECT f.host, f.leaf, f.template, u.purity FROM f JOIN u ON f.host = u.host AND f.template = u.template)
SELECT page_id, r.host, path, rule, CASE WHEN said IS NOT NULL THEN said WHEN purity > {MAX_PURITY} THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN said IS NULL THEN template END AS template, CASE WHEN said IS NULL THEN round(purity, 6) END AS purity
FROM ruled r LEFT JOIN l ON r.host = l.host AND r.leaf = l.leaf"""
