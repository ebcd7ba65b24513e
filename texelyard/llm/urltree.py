"""URL filter by a tree of path templates per host.

Paths are split into segments. Numbers become wildcards at once; other segments
do where a node of the tree has too many different ones and their own labels say little. Branches under one node that
lead to the same rest are put in order of their share of bad labels and stay merged but where the accumulated
labels on both sides of a place differ significantly. A
template is rejected when its smoothed share of bad labels is high. Written
rules go before templates. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from texelyard.llm.common import quoted
from texelyard.session import stage

FANOUT = 16
# Labels from which a segment is a branch whatever the fan-out: by their number alone, or if they differ from the node's rest.
SUPPORTED, COMPARED = 30, 5
SMOOTHING = 8.0
SIMILAR_Z = 1.64
REJECT_SHARE = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMBER = r"^[0-9]+(\.[A-Za-z0-9]+)?$"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.substr(url, at + 3))


def host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def shape(path_text: Column) -> Column:
    """Segments of a path with numbers as wildcards; a suffix such as ``.html`` stays."""
    parts = F.filter(F.split(path_text, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(NUMBER), F.concat(F.lit("*"), F.regexp_extract(s, NUMBER, 1))).otherwise(s))


def rule_for(host_text: Column, path_text: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule (``host/path``) of a list of at most a few hundred, or null.

    A rule fits its host and all subdomains, if the path begins with the rule's.
    Of rules of one length, the first by name is taken.
    """
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=True)[::-1]:
        name, _, rest = rule.partition("/")
        fits = ((host_text == name) | host_text.endswith("." + name)) & path_text.startswith("/" + rest)
        found = F.when(fits, rule).otherwise(found)
    return found


def _joined(parts: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def _contrast(bad: Column, n: Column, other_bad: Column, other_n: Column) -> Column:
    """Square of the two-proportion z of two shares of bad labels; null without labels on both sides or if all labels agree."""
    pooled = F.try_divide(bad + other_bad, n + other_n)
    spread = pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), other_n))
    apart = F.try_divide(bad, n) - F.try_divide(other_bad, other_n)
    return F.when(spread > 0, apart * apart / spread)


def templates(shapes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Add ``template`` to distinct ``host, shape`` rows with ``labelled`` and ``bad``, at any depth of each host's tree.

    A node with more than ``fanout`` different segments gets one wildcard branch for
    those that vary: a segment with ``SUPPORTED`` labels stays a branch, and so does one with ``COMPARED`` labels whose
    share of bad ones differs from that of the rest of the node (two-proportion z of ``SIMILAR_Z``). Nodes are settled from the
    top: what lies below a wildcard is one subtree before it is looked at. A round settles the topmost open wide node of every
    shape and is written to the shared folder, so there are as many rounds as wide nodes above one another, not as levels.
    """
    now = stage(shapes.withColumns({"template": F.col("shape"), "_open": F.lit(0)}), "urls")
    while True:
        levels = now.select("host", "shape", "template", "_open", "labelled", "bad", F.posexplode("template").alias("_at", "_seg"))
        above = F.md5(F.array_join(F.expr("slice(template, 1, _at)"), "/"))
        levels = levels.filter(F.col("_at") >= F.col("_open")).withColumn("_above", above).drop("template")
        node = ["host", "_at", "_above"]
        constant = ~F.col("_seg").startswith("*")
        segments = levels.filter(constant).groupBy(*node, "_seg").agg(F.sum("labelled").alias("_l"), F.sum("bad").alias("_b"))
        wide = segments.groupBy(*node).agg(F.count(F.lit(1)).alias("_n"), F.sum("_l").alias("_nl"), F.sum("_b").alias("_nb")).filter(F.col("_n") > fanout)
        top = levels.join(wide, node).groupBy("host", "shape").agg(F.min(F.struct("_at", "_above", "_seg")).alias("_top"))
        top = stage(top.select("host", "shape", "_top.*"), "urls")
        if top.isEmpty():
            return now.drop("_open")
        apart = _contrast(F.col("_b"), F.col("_l"), F.col("_nb") - F.col("_b"), F.col("_nl") - F.col("_l")) >= SIMILAR_Z**2
        stays = (F.col("_l") >= SUPPORTED) | ((F.col("_l") >= COMPARED) & F.coalesce(apart, F.lit(False)))
        varies = segments.join(wide, node).filter(~stays).select(*node, "_seg", F.lit(True).alias("_varies"))
        settled = top.join(varies, [*node, "_seg"], "left").select("host", "shape", F.col("_at").alias("_spot"), F.coalesce("_varies", F.lit(False)).alias("_varies"))
        grown = F.transform("template", lambda s, k: F.when((k == F.col("_spot")) & F.col("_varies"), F.lit("*")).otherwise(s))
        step = now.join(settled, ["host", "shape"], "left").withColumns(
            {"template": F.when(F.col("_varies"), grown).otherwise(F.col("template")), "_open": F.coalesce(F.col("_spot") + 1, F.col("_open"))}
        )
        now = stage(step.drop("_spot", "_varies"), "urls")


def _parted(rows: DataFrame, similar_z: float) -> DataFrame:
    """Add ``_part`` to labelled siblings: groups of their order by share, cut where both sides differ most, until none does."""
    now = stage(rows.withColumn("_part", F.lit("")), "siblings")
    while True:
        group = W.partitionBy("host", "_key", "_part")
        order = group.orderBy("_share", "template")
        upto = order.rowsBetween(W.unboundedPreceding, 0)
        n, b = F.sum("labelled").over(upto), F.sum("bad").over(upto)
        told = now.withColumns({"_row": F.row_number().over(order), "_n": n, "_b": b, "_all": F.sum("labelled").over(group), "_bad": F.sum("bad").over(group)})
        told = told.withColumn("_q", _contrast(F.col("_b"), F.col("_n"), F.col("_bad") - F.col("_b"), F.col("_all") - F.col("_n")))
        told = told.withColumn("_best", F.max("_q").over(group))
        told = told.withColumn("_cut", F.min(F.when(F.col("_q") == F.col("_best"), F.col("_row"))).over(group))
        side = F.when(F.col("_row") > F.col("_cut"), "1").otherwise("0")
        part = F.when(F.col("_best") >= similar_z**2, F.concat("_part", side)).otherwise(F.col("_part"))
        new = stage(told.select(*[c for c in now.columns if c != "_part"], part.alias("_part"), (F.col("_best") >= similar_z**2).alias("_split")), "siblings")
        if not new.agg(F.max("_split")).first()[0]:
            return new.drop("_split")
        now = new.drop("_split")


def judge_templates(counted: DataFrame, smoothing: float = SMOOTHING, similar_z: float = SIMILAR_Z, reject: float = REJECT_SHARE) -> DataFrame:
    """``host, template`` (as arrays) with ``merged``, ``purity`` and ``rejected``.

    ``counted`` has ``host, template, n, labelled, bad``. Labelled branches of one node with
    the same rest are put in order of their smoothed share of bad labels. Such a row is cut where the
    labels before and after differ most, by a two-proportion z of at least ``similar_z``, and so are its parts; what is
    not cut is merged. The smoothed share leans on the overall one by ``smoothing`` labels. Branches without labels are merged
    with one another: their share is that of all their siblings, and they are rejected if every labelled part is. A
    node without any label is not rejected.
    """
    bad, labelled = counted.agg(F.sum("bad"), F.sum("labelled")).first()
    prior = ((bad or 0) + 1) / ((labelled or 0) + 2)
    share = (F.col("bad") + smoothing * prior) / (F.col("labelled") + smoothing)
    # The last constant segment is the branch; the rest of the template names its siblings.
    constant = F.size("template") - F.array_position(F.transform(F.reverse("template"), lambda s: ~s.startswith("*")), F.lit(True))
    rows = counted.withColumn("_at", F.when(F.exists("template", lambda s: ~s.startswith("*")), constant).otherwise(-1).cast("int"))
    siblings = F.transform("template", lambda s, k: F.when(k == F.col("_at"), F.lit("{}")).otherwise(s))
    rows = rows.select("host", "template", "labelled", "bad", "_at", _joined(siblings).alias("_key"), share.alias("_share"))

    told = _parted(rows.filter("labelled > 0"), similar_z)
    all_parts = told.unionByName(rows.filter("labelled = 0").withColumn("_part", F.lit(None).cast("string")))
    group, node = W.partitionBy("host", "_key", "_part"), W.partitionBy("host", "_key")

    def smoothed(window) -> Column:
        return (F.sum("bad").over(window) + smoothing * prior) / (F.sum("labelled").over(window) + smoothing)

    purity = F.when(F.col("_part").isNull(), smoothed(node)).otherwise(smoothed(group))
    names = F.array_join(F.array_sort(F.collect_set(F.get("template", F.col("_at"))).over(group)), "|")
    merged = F.when(F.col("_at") < 0, F.col("_key")).otherwise(F.replace("_key", F.lit("{}"), F.concat(F.lit("{"), names, F.lit("}"))))
    judged = all_parts.select("host", "template", "_key", "_part", merged.alias("merged"), purity.alias("purity"))
    own = F.when(F.col("_part").isNotNull(), F.col("purity") >= reject)
    rejected = F.coalesce(own, F.min(own).over(node), F.lit(False))
    return judged.withColumn("rejected", rejected).drop("_key", "_part")


def judge_urls(
    pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], url: str = "url", key: str = "page_id", fanout: int = FANOUT, reject: float = REJECT_SHARE
) -> DataFrame:
    """``key, host, path, rule, verdict, template, purity`` of every page.

    ``labelled`` has ``url`` and ``bad`` (1 or 0; null counts as not labelled);
    ``rules`` lists (``allow`` or ``block``, rule). The longest fitting rule decides,
    else the page's template: ``block`` if it is rejected. A null url, or one without ``://``,
    has empty host and path and the template ``/`` of no host. Repeated pages are judged each.

    Only url, key and labels are read. The tree grows on distinct hosts and shapes,
    after equal ones have been counted in each task, so a host with a third of all
    pages is a few rows there; the join of pages to templates is left to skew handling.
    """
    link = quoted(url)
    seen = pages.select(quoted(key).alias(key), host(link).alias("host"), path(link).alias("path")).withColumn("shape", shape(F.col("path")))
    told = labelled.filter("bad IS NOT NULL").select(host(F.col("url")).alias("host"), shape(path(F.col("url"))).alias("shape"), F.col("bad").cast("long").alias("bad"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    both = seen.select("host", "shape", one.alias("n"), zero.alias("labelled"), zero.alias("bad")).unionAll(told.select("host", "shape", zero.alias("n"), one.alias("labelled"), "bad"))
    counted = both.groupBy("host", "shape").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
    grown = templates(counted, fanout)
    judged = judge_templates(grown.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")]), reject=reject)
    known = grown.select("host", "shape", "template").join(judged, ["host", "template"]).select("host", "shape", "merged", "purity", "rejected")
    out = seen.join(known, ["host", "shape"]).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    said = reduce(lambda rest, r: F.when(F.col("rule") == r[1], r[0]).otherwise(rest), rules, F.when(F.col("rejected"), "block").otherwise("allow"))
    return out.select(key, "host", "path", "rule", said.alias("verdict"), F.col("merged").alias("template"), "purity")
