"""Operator 7: URL verdicts by rules, and by a path-template tree with smoothed labelled purity where no rule fits.

URLs become (host, path) counts first: segments that are numbers, long hexadecimal strings or very long are generalised,
so a host with a third of all rows is a handful of counts after map-side aggregation.  Then, level by level from a host's
root, a place with many children that rarely repeat becomes a wildcard; a place of fewer than WILD URLs can have none
below it, so a round goes on with the others only, to any depth.  A branch whose labelled share of blocks does not differ
from its parent's, both with all that is below them, is merged with it; each template climbs so to the lowest branch that
differs.  A merged branch's purity, the smoothed share of blocked labels, falls back on its host's and that on all hosts';
pure branches with enough labels are rejected.  The labels are the verdicts of the rules on the URLs that they fit.
DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, stage

#: The rules (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: A place becomes a wildcard with so many different children, if they are at least half of its URLs.
WILD = 16
#: Weight of a parent's purity in a child's; least purity and labels of a rejected template; z of "does not differ".
WEIGHT, PURE, LEAST_LABELS, Z = 4.0, 0.9, 5, 1.96

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.coalesce(F.translate(F.regexp_extract(url, "^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits; of equal length the first given."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, own_host, own_path in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        name, verdict = F.when(fits, own_host + own_path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


#: Marks of generalised segments; a segment holds no slash, so none can look like a mark.
NUMBER, CODE, LONG, ANY = "/n", "/x", "/long", "/*"


def _segment(s: Column) -> Column:
    number, code = s.rlike(r"^[0-9]+(\.[a-z]+)?$"), s.rlike(r"^[0-9a-f-]{16,}$")
    return F.when(number, NUMBER).when(code, CODE).when(F.char_length(s) > 32, LONG).otherwise(s)


def _text(parts: Column | str) -> Column:
    """Segments as one string; none of them is empty or holds a slash but a mark, which begins with it."""
    return F.array_join(parts, "/")


def templates(tree: DataFrame) -> DataFrame:
    """host, key, n, labels, blocks, template (an array of segments) from host, key, segs, n, labels, blocks."""
    none = F.array().cast("array<string>")
    active, done, level = tree.withColumn("before", none).withColumn("place", F.lit("")), [], 0
    while True:
        ended = F.size("segs") <= level
        done.append(active.filter(ended).select("host", "key", "n", "labels", "blocks", F.col("segs").alias("last"), "before", F.lit(level).alias("from")))
        going = active.filter(~ended).withColumn("own", F.element_at("segs", level + 1))
        children = going.groupBy("host", "place", "own").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
        places = children.groupBy("host", "place").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("urls"), F.sum("rows").alias("rows")).filter(F.col("urls") >= WILD)
        places = places.select("host", "place", "rows", ((F.col("k") >= WILD) & (2 * F.col("k") >= F.col("urls"))).alias("wild"))
        met = stage(join_counted(going, places, ["host", "place"], "rows", going.count(), "key"), f"level{level + 1}")
        done.append(met.filter("wild is null").select("host", "key", "n", "labels", "blocks", F.col("segs").alias("last"), "before", F.lit(level).alias("from")))
        active = met.filter("wild is not null").withColumn("before", F.concat("before", F.array(F.when(F.col("wild"), ANY).otherwise(F.col("own"))))).drop("own", "rows", "wild")
        active, level = active.withColumn("place", _text("before")), level + 1
        if active.isEmpty():
            break
    rest = F.slice("last", F.col("from") + 1, F.greatest(F.size("last"), F.lit(1)))
    return reduce(DataFrame.union, done).select("host", "key", "n", "labels", "blocks", F.concat("before", rest).alias("template"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    A null URL, or one without `://`, has an empty host and path, no rule, and the template of the empty path.  URLs and
    paths of any length and depth are read whole.  Of fitting rules of equal length the first given wins.  Repeated rows
    repeat; null ids stay null; an empty table gives no rows; other columns are not read, so their names may clash.
    """
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("rule_verdict"), F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), _segment).alias("segs"))
    rows = rows.withColumn("key", _text("segs"))
    block = F.col("rule_verdict") == "block"
    counts = rows.groupBy("host", "key").agg(F.first("segs").alias("segs"), F.count(F.lit(1)).alias("n"), F.count("rule_verdict").alias("labels"), F.count_if(block).alias("blocks"))
    tree = stage(templates(stage(counts, "tree")).withColumn("leaf", _text("template")), "templates")
    size, total, labels, blocks = tree.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "labels", "blocks"))).first()
    everywhere = (blocks + 1.0) / (labels + 2.0)

    leaves = tree.groupBy("host", "leaf").agg(F.first("template").alias("template"), F.sum("labels").alias("labels"), F.sum("blocks").alias("blocks"), F.count(F.lit(1)).alias("keys"))
    leaves = stage(leaves, "leaves")
    step = lambda j: F.struct(j.alias("depth"), _text(F.slice("template", F.lit(1), j)).alias("branch"), F.when(j > 0, _text(F.slice("template", F.lit(1), j - 1))).alias("parent"))
    above = leaves.select("host", "leaf", "labels", "blocks", F.explode(F.transform(F.sequence(F.lit(0), F.size("template")), step)).alias("at")).select("host", "leaf", "labels", "blocks", "at.*")
    branches = above.groupBy("host", "depth", "branch", "parent").agg(F.sum("labels").alias("labels"), F.sum("blocks").alias("blocks"), F.count(F.lit(1)).alias("leaves"))
    branches = stage(branches, "branches")
    n_branches = branches.count()
    children = branches.filter("depth > 0").groupBy("host", F.col("parent").alias("branch"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("children"))
    parents = branches.join(children, ["host", "branch", "depth"]).select("host", F.col("branch").alias("parent"), (F.col("depth") + 1).alias("depth"), ((F.col("blocks") + 1.0) / (F.col("labels") + 2.0)).alias("p"), "children")
    met = join_counted(branches.filter("depth > 0 and labels > 0"), parents, ["host", "parent", "depth"], "children", n_branches, "branch")
    differs = F.abs(F.col("blocks") - F.col("labels") * F.col("p")) > Z * F.sqrt(F.col("labels") * F.col("p") * (1.0 - F.col("p")))
    apart = stage(met.filter(differs).select("host", "depth", "branch", "leaves"), "apart")
    lowest = join_counted(above.select("host", "leaf", "depth", "branch"), apart.withColumn("apart", F.lit(True)), ["host", "depth", "branch"], "leaves", n_branches, "leaf")
    lowest = lowest.filter("apart").groupBy("host", "leaf").agg(F.max(F.struct("depth", "branch")).alias("top"))
    root = F.struct(F.lit(0).alias("depth"), F.lit("").alias("branch"))
    group = leaves.join(lowest, ["host", "leaf"], "left").select("host", "leaf", "labels", "blocks", "keys", F.coalesce("top", root).alias("top"))
    group = stage(group, "groups")
    n_leaves = group.count()
    merged = group.groupBy("host", "top").agg(F.sum("labels").alias("own_labels"), F.sum("blocks").alias("own_blocks"), F.count(F.lit(1)).alias("group_rows")).filter(F.col("own_labels") >= LEAST_LABELS)
    hosts = group.groupBy("host").agg(F.sum("labels").alias("host_labels"), F.sum("blocks").alias("host_blocks"))
    host_purity = (F.col("host_blocks") + WEIGHT * F.lit(everywhere)) / (F.col("host_labels") + WEIGHT)
    purity = (F.col("own_blocks") + WEIGHT * host_purity) / (F.col("own_labels") + WEIGHT)
    pure = merged.join(hosts, "host").filter(purity >= PURE).select("host", "top", "group_rows", F.lit(True).alias("pure"))
    rejected = join_counted(group, pure, ["host", "top"], "group_rows", n_leaves, "leaf").filter("pure").select("host", "leaf", F.lit(True).alias("rejected"), "keys")
    keys = join_counted(tree.select("host", "key", "leaf", "n"), rejected, ["host", "leaf"], "keys", size, "key").filter("rejected").select("host", "key", "rejected", "n")
    out = join_counted(rows.select("page_id", "host", "path", "rule", "rule_verdict", "key"), keys, ["host", "key"], "n", total, "page_id")
    method = F.when(F.col("rejected"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"))


def _oracle(levels: int = 6) -> str:
    """The same in SQL, where no place of WILD or more URLs is deeper than `levels`."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    name = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in longest) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in longest) + " END"
    segment = f"CASE WHEN regexp_matches(s, '^[0-9]+(\\.[a-z]+)?$') THEN '{NUMBER}' WHEN regexp_matches(s, '^[0-9a-f-]{{16,}}$') THEN '{CODE}' WHEN length(s) > 32 THEN '{LONG}' ELSE s END"
    sql = f"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, {name} AS rule, {verdict} AS rv, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {segment}) AS segs FROM u),
k0 AS (SELECT host, segs, count(*) AS n, count(rv) AS labels, count(*) FILTER (rv = 'block') AS blocks, []::VARCHAR[] AS pre, TRUE AS act FROM r GROUP BY host, segs),
"""
    for i in range(1, levels + 1):
        sql += f"""p{i} AS (SELECT host, pre, count(*) >= {WILD} AND 2 * count(*) >= sum(n) AS wild FROM (SELECT host, pre, segs[{i}] AS s, sum(n) AS n FROM k{i - 1} WHERE act AND len(segs) >= {i}
  GROUP BY host, pre, segs[{i}]) GROUP BY host, pre HAVING sum(n) >= {WILD}),
k{i} AS (SELECT k.host, k.segs, k.n, k.labels, k.blocks, CASE WHEN p.host IS NOT NULL THEN list_append(k.pre, CASE WHEN p.wild THEN '{ANY}' ELSE k.segs[{i}] END) ELSE k.pre END AS pre, p.host IS NOT NULL AS act
  FROM k{i - 1} k LEFT JOIN p{i} p ON k.act AND len(k.segs) >= {i} AND k.host = p.host AND k.pre = p.pre),
"""
    share = f"(y.blocks + 1.0::DOUBLE) / (y.labels + 2.0::DOUBLE)"
    return sql + f"""
t AS (SELECT host, segs, labels, blocks, list_concat(pre, segs[len(pre) + 1:]) AS tmpl FROM k{levels}),
l AS (SELECT host, tmpl, sum(labels) AS labels, sum(blocks) AS blocks FROM t GROUP BY host, tmpl),
a AS (SELECT host, tmpl, labels, blocks, unnest(range(0, len(tmpl) + 1)) AS j FROM l),
b AS (SELECT host, tmpl[1:j] AS branch, sum(labels) AS labels, sum(blocks) AS blocks FROM a GROUP BY host, tmpl[1:j]),
f AS (SELECT x.host, x.branch FROM b x JOIN b y ON x.host = y.host AND len(x.branch) > 0 AND y.branch = x.branch[1:len(x.branch) - 1]
  WHERE x.labels > 0 AND abs(x.blocks - x.labels * ({share})) > {Z}::DOUBLE * sqrt(x.labels * ({share}) * (1.0::DOUBLE - ({share})))),
g AS (SELECT a.host, a.tmpl, coalesce(max(CASE WHEN f.host IS NOT NULL THEN a.j END), 0) AS j FROM a LEFT JOIN f ON a.host = f.host AND a.tmpl[1:a.j] = f.branch GROUP BY a.host, a.tmpl),
m AS (SELECT g.host, g.tmpl[1:g.j] AS top, sum(labels) AS labels, sum(blocks) AS blocks FROM g JOIN l ON g.host = l.host AND g.tmpl = l.tmpl GROUP BY g.host, g.tmpl[1:g.j]),
h AS (SELECT host, (sum(blocks) + {WEIGHT}::DOUBLE * (SELECT (sum(blocks) + 1.0::DOUBLE) / (sum(labels) + 2.0::DOUBLE) FROM l)) / (sum(labels) + {WEIGHT}::DOUBLE) AS p FROM l GROUP BY host),
x AS (SELECT m.host, m.top FROM m JOIN h ON m.host = h.host WHERE m.labels >= {LEAST_LABELS} AND (m.blocks + {WEIGHT}::DOUBLE * h.p) / (m.labels + {WEIGHT}::DOUBLE) >= {PURE}::DOUBLE),
z AS (SELECT t.host, t.segs FROM t JOIN g ON t.host = g.host AND t.tmpl = g.tmpl JOIN x ON x.host = g.host AND x.top = g.tmpl[1:g.j])
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.rv, CASE WHEN z.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN z ON r.host = z.host AND r.segs = z.segs
"""


ORACLE_SQL = _oracle()
