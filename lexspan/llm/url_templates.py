"""URL filter: a tree of path templates for each host, with DataFrame functions only.

URLs become branches first: host and all path segments, with counts of pages and of
labelled pages. The tree is built over branches, level by level from the root, until no branch has a further
segment. A branch that is alone in its node is finished at once, so there are as many levels as branches of one host
share segments. At each node:

- Generalising: where a node has BRANCHES or more different segments, a segment that holds less than
  one in RARE of its pages becomes a wildcard of its shape: {n} digits, {x} with digits, {w} others.
- Merging: a child whose labelled rate isn't told apart from that of its siblings together by a
  two-proportion test becomes one branch with all such children, {=}. A child or its siblings with fewer
  than TESTED labels can't be told apart.

A template is rejected when its smoothed share of bad labels is REJECT or more; the prior is the share among all
labels, with a weight of WEIGHT labels. A template without labels is never rejected. Rules by host and path come before templates.

Every step is an aggregation with partial sums or a join on host, template and segment, so a host with a third
of all pages is split by its segments.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.common import ascii_lower, settled

#: Levels that the SQL is written out for; the job itself has no such limit.
SQL_DEPTH = 8
BRANCHES, RARE = 10, 20
TESTED, Z = 5, 1.96
WEIGHT, REJECT = 10, 0.5
#: (verdict, host, path) of the query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Stands for "no further segment"; a segment can't be a slash.
STOP = "/"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def by_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; of equally long ones the first by name. Null where none fits."""
    names = sorted({h + p: v for v, h, p in rules}.items(), key=lambda r: (-len(r[0]), r[0]))
    parts = {h + p: (h, p) for _, h, p in rules}

    def fits(name: str) -> Column:
        h, p = parts[name]
        return ((host == h) | host.endswith("." + h)) & path.startswith(p)

    pick = lambda values: reduce(lambda rest, x: F.when(fits(x[0]), F.lit(x[1])).otherwise(rest), reversed(values), F.lit(None).cast("string"))
    return pick([(n, n) for n, _ in names]), pick(names)


def _shape(segment: Column) -> Column:
    return F.when(segment.rlike("^[0-9]+$"), "{n}").when(segment.rlike("[0-9]"), "{x}").otherwise("{w}")


def templates(branches: DataFrame) -> DataFrame:
    """branches (host, segments, n, labelled, bad) with their template."""
    active = branches.withColumn("t", F.lit(""))
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    finished, k = [], 0
    while True:
        here = active.withColumn("seg", F.coalesce(F.get("segments", F.lit(k)), F.lit(STOP)))
        child = here.groupBy("host", "t", "seg").agg(F.count("*").alias("branches"), *sums)
        node = child.groupBy("host", "t").agg(
            F.count("*").alias("kinds"), F.sum("branches").alias("all_branches"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        rare = (F.col("kinds") >= BRANCHES) & (F.col("n") * RARE < F.col("all_n")) & (F.col("seg") != STOP)
        wild = child.join(node, ["host", "t"]).withColumn("token", F.when(rare, _shape(F.col("seg"))).otherwise(F.col("seg")))
        mine = wild.groupBy("host", "t", "token", "all_labelled", "all_bad").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        n1, b1 = F.col("labelled").cast("double"), F.col("bad").cast("double")
        n2, b2 = F.col("all_labelled") - n1, F.col("all_bad") - b1
        # |b1/n1 - b2/n2| / sqrt(p (1 - p) (1/n1 + 1/n2)) >= Z with the pooled share p, squared and without divisions
        apart = (b1 * n2 - b2 * n1) * (b1 * n2 - b2 * n1) * (n1 + n2) >= Z * Z * (b1 + b2) * (n1 + n2 - b1 - b2) * n1 * n2
        tested = (n1 >= TESTED) & (n2 >= TESTED)
        final = F.when((F.col("token") == STOP) | (tested & apart & (b1 * n2 != b2 * n1)), F.col("token")).otherwise("{=}")
        merged = mine.select("host", "t", "token", final.alias("final"))
        step = wild.select("host", "t", "seg", "token", (F.col("all_branches") == 1).alias("alone")).join(merged, ["host", "t", "token"]).select("host", "t", "seg", "final", "alone")
        # alone, all further segments have no sibling to be told from
        rest = F.repeat(F.lit("/{=}"), F.greatest(F.size("segments") - k, F.lit(0)))
        grown = F.when(F.col("final") == STOP, F.col("t")).when(F.col("alone"), F.concat("t", rest)).otherwise(F.concat("t", F.lit("/"), "final"))
        done = (F.col("final") == STOP) | F.col("alone")
        out = settled(here.join(step, ["host", "t", "seg"]).select("host", "segments", "n", "labelled", "bad", grown.alias("t"), done.alias("done")), "templates")
        finished.append(out.where("done").drop("done"))
        active, k = out.where("NOT done").drop("done"), k + 1
        if active.isEmpty():
            return reduce(DataFrame.unionByName, finished).withColumn("template", F.concat("host", "t"))


def judged(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, n_pages of the template.

    ``labels``: (page_id, bad boolean); an id labelled twice is bad if any of its labels is, null ids and labels are left out. Null
    urls and urls without ``://`` have empty host and path, and share the empty host's template. Repeated pages
    count each. Paths of any length enter the tree whole, and a segment of any length is one. An empty table gives an empty result; other columns aren't read.
    """
    host, path = host_and_path(F.col(url_col))
    rule, given = by_rules(F.col("host"), F.col("path"), RULES if rules is None else rules)
    known = labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("is_bad"))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    seg = F.split(F.col("path"), "/")
    cut = urls.select("*", F.slice(seg, F.lit(2), F.size(seg)).alias("segments"))
    key = ["host", "segments"]
    counted = cut.join(known, "page_id", "left")
    branches = counted.groupBy(*key).agg(F.count("*").alias("n"), F.count("is_bad").alias("labelled"), F.coalesce(F.sum("is_bad"), F.lit(0)).alias("bad"))
    tree = templates(settled(branches, "branches"))
    per = tree.groupBy("template").agg(F.sum("n").alias("n_pages"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    prior = per.agg(F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled"))
    share = F.coalesce(F.expr("try_divide(all_bad, all_labelled)"), F.lit(0.0))
    # one row of two sums
    purity = per.join(F.broadcast(prior)).withColumn("reject", (F.col("labelled") > 0) & ((F.col("bad") + WEIGHT * share) >= REJECT * (F.col("labelled") + WEIGHT)))
    of_branch = tree.select(*key, "template").join(purity.select("template", "n_pages", "reject"), "template")
    out = cut.join(of_branch, key).select("page_id", "host", "path", "template", "n_pages", "reject").withColumn("rule", rule).withColumn("given", given)
    verdict = F.coalesce("given", F.when(F.col("reject"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "n_pages")


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the labels table serve by number: a page is bad if the row of its number is of low quality or toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def _sql() -> str:
    """The same in SQL."""
    ctes = []
    for k in range(1, SQL_DEPTH + 1):
        p = f"b{k - 1}"
        ctes.append(f"""
c{k} AS (SELECT host, t, s{k} AS seg, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad FROM {p} GROUP BY ALL),
w{k} AS (SELECT c.*, p.all_labelled, p.all_bad,
    CASE WHEN kinds >= {BRANCHES} AND c.n * {RARE} < all_n AND seg <> '{STOP}' THEN
      CASE WHEN regexp_matches(seg, '^[0-9]+$') THEN '{{n}}' WHEN regexp_matches(seg, '[0-9]') THEN '{{x}}' ELSE '{{w}}' END
    ELSE seg END AS token
  FROM c{k} c JOIN (SELECT host, t, count(*) AS kinds, sum(n) AS all_n, sum(labelled) AS all_labelled, sum(bad) AS all_bad FROM c{k} GROUP BY ALL) p USING (host, t)),
m{k} AS (SELECT host, t, token, sum(labelled)::DOUBLE AS n1, sum(bad)::DOUBLE AS b1, any_value(all_labelled)::DOUBLE - sum(labelled) AS n2, any_value(all_bad)::DOUBLE - sum(bad) AS b2
  FROM w{k} GROUP BY host, t, token),
f{k} AS (SELECT host, t, token,
    CASE WHEN token = '{STOP}' OR (n1 >= {TESTED} AND n2 >= {TESTED} AND b1 * n2 <> b2 * n1
      AND (b1 * n2 - b2 * n1) * (b1 * n2 - b2 * n1) * (n1 + n2) >= {Z * Z!r}::DOUBLE * (b1 + b2) * (n1 + n2 - b1 - b2) * n1 * n2) THEN token ELSE '{{=}}' END AS final FROM m{k}),
b{k} AS (SELECT b.* EXCLUDE (t), CASE WHEN final = '{STOP}' THEN b.t ELSE b.t || '/' || final END AS t
  FROM {p} b JOIN w{k} w ON b.host = w.host AND b.t = w.t AND b.s{k} = w.seg JOIN f{k} f ON f.host = w.host AND f.t = w.t AND f.token = w.token)""")
    segments = ", ".join(f"coalesce(string_split(path, '/')[{k + 1}], '{STOP}') AS s{k}" for k in range(1, SQL_DEPTH + 1))
    keys = ", ".join(["host", *(f"s{k}" for k in range(1, SQL_DEPTH + 1)), "more"])
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    case = lambda out: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{out(v, h + p)}'" for v, h, p in order) + " END"
    return f"""WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
cut AS (SELECT *, {segments}, len(string_split(path, '/')) > {SQL_DEPTH + 1} AS more FROM urls),
known AS (SELECT doc_id AS page_id, max((quality = 0 OR toxic = 1)::INT) AS is_bad FROM labels WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
b0 AS (SELECT {keys}, count(*) AS n, count(is_bad) AS labelled, coalesce(sum(is_bad), 0) AS bad, '' AS t FROM cut LEFT JOIN known USING (page_id) GROUP BY ALL),
{",".join(ctes)},
tree AS (SELECT *, host || t || CASE WHEN more THEN '/**' ELSE '' END AS template FROM b{SQL_DEPTH}),
per AS (SELECT template, sum(n)::BIGINT AS n_pages, sum(labelled) AS labelled, sum(bad) AS bad FROM tree GROUP BY template),
prior AS (SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(labelled), 0), 0) AS share FROM per),
purity AS (SELECT template, n_pages, labelled > 0 AND bad + {WEIGHT} * share >= {REJECT} * (labelled + {WEIGHT}) AS reject FROM per, prior)
SELECT page_id, host, path, {case(lambda v, n: n)} AS rule, coalesce({case(lambda v, n: v)}, CASE WHEN reject THEN 'block' ELSE 'allow' END) AS verdict, template, n_pages
FROM cut JOIN tree USING ({keys}) JOIN purity USING (template)"""


OP5_SQL = _sql()
