"""Join-shaped operators: prefix rules, change detection, aliases, fuzzy titles, nearest events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.text import squeeze


def prefix_labels(rows: DataFrame, rules: DataFrame, path: str, default: str, label: str = "label") -> DataFrame:
    """Label of the first rule (by ord) whose prefix the path has; rules are an ordered, bounded configuration table."""
    r = rules.select(F.struct("prefix", "ord", F.col(label).alias("v")).alias("rule")).agg(F.sort_array(F.collect_list(F.struct(F.col("rule.ord"), F.col("rule.prefix"), F.col("rule.v")))).alias("_rules"))
    hit = F.filter("_rules", lambda x: F.col(path).startswith(x["prefix"]))
    return rows.crossJoin(F.broadcast(r)).withColumn(label, F.coalesce(F.try_element_at(hit, F.lit(1))["v"], F.lit(default))).drop("_rules")


def changed(current: DataFrame, state: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose hash differs from the stored one or has none."""
    s = state.select(F.col(key).alias("_k"), F.col("content_hash").alias("_h"))
    return current.join(s, F.col(key) == F.col("_k"), "left").where(~F.col("content_hash").eqNullSafe(F.col("_h"))).drop("_k", "_h")


def deleted(current: DataFrame, state: DataFrame, key: str = "doc_id") -> DataFrame:
    return state.join(current.select(key), key, "left_anti")


def freshness(sources: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, status) of sources(doc_id, hash, updated) against index(doc_id, hash, built): missing, stale, changed or orphaned."""
    s, i = sources.select("doc_id", "hash", "updated"), index.select(F.col("doc_id").alias("_d"), F.col("hash").alias("_h"), "built")
    both = s.join(i, F.col("doc_id") == F.col("_d"), "full_outer")
    status = F.when(F.col("doc_id").isNull(), "orphaned").when(F.col("_d").isNull(), "missing").when(F.col("hash") != F.col("_h"), "changed").when(F.col("updated") > F.col("built"), "stale")
    return both.select(F.coalesce("doc_id", "_d").alias("doc_id"), status.alias("status")).where("status is not null")


def message_key(text: Column) -> Column:
    """Hash of a message, no-break spaces as spaces, trimmed."""
    return F.sha1(F.trim(F.translate(text, "\u00a0", " ")))


def unseen(messages: DataFrame, seen: DataFrame) -> DataFrame:
    """Messages whose hash is not among those seen(msg_hash)."""
    return messages.withColumn("msg_hash", message_key(F.col("text"))).join(seen.select("msg_hash").distinct(), "msg_hash", "left_anti")


def unmapped(names: DataFrame, registry: DataFrame, ignored: DataFrame) -> DataFrame:
    """names(name) that are neither a canonical name, nor an alias, nor ignored."""
    known = registry.select("canonical").union(registry.select(F.explode("aliases"))).union(ignored.select("name")).toDF("name").distinct()
    return names.join(known, "name", "left_anti")


def alias_variants(questions: DataFrame, registry: DataFrame) -> DataFrame:
    """(question_id, ord, variant): the question, then with the first name of an entry found in it replaced by each other name.

    registry(canonical, aliases[, more]): names in ``more`` take the place of those found, but are not looked for. The
    registry is a curated table (one row an entry). A name can only stand where a word of the question holds its
    longest word, so questions meet entries on words.
    """
    from sheaf.operators.retrieval import held_by, postings

    more = F.col("more") if "more" in registry.columns else F.array().cast("array<string>")
    names = registry.select("canonical", F.concat(F.array("canonical"), F.col("aliases")).alias("names"), more.alias("more"))
    longest = F.array_max(F.transform(F.split(squeeze(F.lower("name")), " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = names.select("canonical", F.explode("names").alias("name")).select("canonical", longest.alias("term")).where("term <> ''").distinct()
    p = postings(questions, ["question_id"], {"text": squeeze(F.lower("text"))})
    meet = held_by(asked, p).join(p, "token").select("question_id", "canonical").distinct()
    found = questions.join(meet, "question_id").join(names, "canonical")
    pattern = lambda n: F.concat(F.lit("(?i)(^|[^A-Za-z0-9])\\Q"), n, F.lit("\\E([^A-Za-z0-9]|$)"))
    hit = F.try_element_at(F.filter("names", lambda n: F.regexp_like(F.col("text"), pattern(n))), F.lit(1))
    found = found.withColumn("hit", hit).where(F.col("hit").isNotNull())
    other = found.select("question_id", "text", "hit", "canonical", F.posexplode(F.concat(F.filter("names", lambda n: n != F.col("hit")), F.col("more"))).alias("pos", "other"))
    swapped = F.regexp_replace(F.col("text"), pattern(F.col("hit")), F.concat(F.lit("$1"), F.col("other"), F.lit("$2")))
    return questions.select("question_id", F.struct(F.lit("").alias("c"), F.lit(0).alias("p")).alias("ord"), F.col("text").alias("variant")).unionByName(
        other.select("question_id", F.struct(F.col("canonical").alias("c"), (F.col("pos") + 1).alias("p")).alias("ord"), swapped.alias("variant"))
    )


def fuzzy_titles(left: DataFrame, right: DataFrame, least: float = 0.6, bonus: float = 0.2) -> DataFrame:
    """(left_id, right_id, score): the best right title by shared tokens over the smaller set, more if one holds the other.

    left(id, tokens), right(id, tokens). Equal sets are compared once. A pair that reaches ``least`` shares at least
    that part of the smaller set, so one of that set's rarest tokens, all but as many as may be lacking, is in the
    other set: candidates meet on those tokens alone, and a token of most titles brings hardly any together.
    """
    own = lambda rows: rows.select("id", F.array_sort(F.array_distinct("tokens")).alias("tokens")).where(F.size("tokens") > 0)
    members = own(left).select(F.col("id").alias("left_id"), "tokens")
    a, b = members.select("tokens").distinct(), own(right).groupBy("tokens").agg(F.min("id").alias("right_id"))
    every = a.select("tokens").unionByName(b.select("tokens"))
    often = every.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    share = F.greatest(F.lit(1.0), F.ceil(F.lit(least - 1e-9) * F.size("tokens")))
    rare = every.distinct().select("tokens", F.explode("tokens").alias("token")).join(often, "token").groupBy("tokens").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))
    rare = rare.select("tokens", F.explode(F.slice("t", F.lit(1), (F.size("tokens") - share + 1).cast("int"))["token"]).alias("token"))
    lead = lambda rows: rows.join(rare, "tokens")
    full = lambda rows: rows.select("tokens", F.explode("tokens").alias("token"))
    left_lead, right_full = lead(a).select(F.col("tokens").alias("x"), "token"), full(b).withColumnRenamed("tokens", "y")
    right_lead, left_full = lead(b).select(F.col("tokens").alias("y"), "token"), full(a).withColumnRenamed("tokens", "x")
    pairs = left_lead.join(right_full, "token").where(F.size("x") <= F.size("y")).select("x", "y").union(right_lead.join(left_full, "token").where(F.size("y") <= F.size("x")).select("x", "y")).distinct()
    small, shared = F.least(F.size("x"), F.size("y")), F.size(F.array_intersect("x", "y"))
    scored = pairs.withColumn("score", shared / small + F.when(shared == small, bonus).otherwise(0.0)).where(F.col("score") >= least)
    scored = scored.join(b.withColumnRenamed("tokens", "y"), "y")
    best = scored.groupBy("x").agg(F.min_by("right_id", F.struct(-F.round("score", 9), "right_id")).alias("right_id"), F.max("score").alias("score"))
    return members.join(best, members.tokens == best.x).select("left_id", "right_id", "score")


def nearest_event(rows: DataFrame, events: DataFrame, by: str) -> DataFrame:
    """rows(id, by, day) with the event(event_id, by, event_day) of the same group: same day, else within a day, else latest before, else earliest.

    Only distinct days of a group are put in order, of which the calendar has few, however many rows a group has. Of
    events on one day the smallest id counts. Rows without a day, or in a group without events, are left out.
    """
    e = events.where("event_day is not null").groupBy(by, F.col("event_day").alias("day")).agg(F.min("event_id").alias("event_id"))
    days = rows.where("day is not null").select(by, "day").distinct().join(e, [by, "day"], "full_outer")
    w = Window.partitionBy(by).orderBy("day")
    event = F.when(F.col("event_id").isNotNull(), F.struct("day", "event_id"))
    days = days.withColumn("before", F.last(event, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first(event, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    near = lambda side: F.when(F.abs(F.datediff(f"{side}.day", "day")) == 1, F.col(f"{side}.event_id"))
    beside = F.least(near("before"), near("after"))  # the one that there is, where one is null
    found = F.coalesce("event_id", beside, "before.event_id", "after.event_id")
    tier = F.when(F.col("event_id").isNotNull(), 0).when(beside.isNotNull(), 1).when(F.col("before").isNotNull(), 2).otherwise(3)
    chosen = days.select(by, "day", found.alias("event_id"), tier.alias("tier")).where("event_id is not null")
    return rows.join(chosen, [by, "day"]).select("id", "event_id", "tier")


def longest_keyword(lines: DataFrame, keywords: DataFrame) -> DataFrame:
    """lines(line_id, text) with the longest keyword found in each; keywords(keyword, source) may be many.

    A keyword can only stand where a word holds the last of its longest parts: lines meet keywords on words by
    the dictionary of words, and those that meet are compared.
    """
    from sheaf.operators.retrieval import held_by, postings

    low = lines.select("line_id", squeeze(F.lower("text")).alias("low"), F.lower("text").alias("raw"))
    p = postings(low, ["line_id"], {"text": F.col("low")})
    parts = F.transform(F.split(squeeze(F.lower("keyword")), " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    asked = keywords.select("keyword", "source", F.array_max(parts)["w"].alias("term")).where("term <> ''")
    near = held_by(asked.select("term").distinct(), p).join(p, "token").select("term", "line_id").distinct().join(asked, "term")
    hits = near.join(low.select("line_id", "raw"), "line_id").where(F.col("raw").contains(F.lower("keyword")))
    best = F.struct((-F.length("keyword")).alias("n"), F.col("keyword"))
    return hits.groupBy("line_id").agg(F.min_by("keyword", best).alias("keyword"), F.min_by("source", best).alias("source"))
