"""Fuzzy deduplication: first-match leader clustering as a sequence of joins.

The rule: listings are taken in order (source priority, then input order); each joins the first earlier
survivor whose company matches at 0.8 and title at 0.75, else it survives itself. The result here is the
same as that one-by-one rule, reached without all pairs:

1. Rows with equal match keys behave alike, so only distinct (company key, title key) nodes are compared,
   each standing at its first row's position.
2. Company names are matched once, over distinct names.
3. Titles are compared only inside matched companies, through the signature join of `similar` where these are large.
4. Survivors are decided by repeated joins over the match edges: a node with no undecided or surviving
   earlier match survives, a node with a surviving earlier match does not.
5. A company with very many distinct titles is taken in growing portions of its order. Each portion's
   survivors first absorb everything that matches them, so a crowd of near-copies is never paired with
   itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.functions.infer import company_key, source_priority, title_key
from vacancia.functions.similarity import fuzzy_match, near_in_letters, near_in_size, ratio
from vacancia.functions.text import blank_to_null, lowered
from vacancia.operators import similar
from vacancia.operators.order import by_source_priority, rank_within, with_position
from vacancia.operators.similar import candidate_pairs, signatures, similar_names
from vacancia.session import materialize

COMPANY_THRESHOLD = 0.8
TITLE_THRESHOLD = 0.75
FILLED_FIELDS = ("salary_min", "salary_max", "salary_currency", "posted_date_raw", "employment_type")
PORTION_NODES = 2048  # size of a company's first portion; later portions grow four-fold
_PORTION_STEPS = 8
_FRACTIONS = [4.0 ** -(_PORTION_STEPS - i) for i in range(_PORTION_STEPS + 1)]
ALTERNATE = ("source", "url", "source_id")
CHUNK = 10_000  # entries of an array in one interchange row; a larger cluster has further rows


def with_match_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("ck", company_key("company")).withColumn("tk", title_key("title"))


def match_nodes(ordered: DataFrame) -> DataFrame:
    """Distinct match keys with the position of their first row; blank keys never match anything."""
    return ordered.filter((F.col("ck") != "") & (F.col("tk") != "")).groupBy("ck", "tk").agg(F.min("ord").alias("ord"))


def _company_links(nodes: DataFrame) -> DataFrame:
    """home, guest, home_later, guest_later: matched companies, the one with more titles as home."""
    sizes = materialize(nodes.groupBy("ck").agg(F.count("*").alias("n")), "company-sizes")
    pairs = similar_names(sizes, "ck", COMPANY_THRESHOLD)
    sized = (
        pairs.join(sizes.select(F.col("ck").alias("a"), F.col("n").alias("na")), "a")
        .join(sizes.select(F.col("ck").alias("b"), F.col("n").alias("nb")), "b")
    )
    a_home = F.col("na") >= F.col("nb")
    links = sized.select(
        F.when(a_home, F.col("a")).otherwise(F.col("b")).alias("home"),
        F.when(a_home, F.col("b")).otherwise(F.col("a")).alias("guest"),
        F.when(a_home, F.col("a_later")).otherwise(F.col("b_later")).alias("home_later"),
        F.when(a_home, F.col("b_later")).otherwise(F.col("a_later")).alias("guest_later"),
    )
    own = sizes.select(F.col("ck").alias("home"), F.col("ck").alias("guest"), F.lit(True).alias("home_later"), F.lit(True).alias("guest_later"))
    return materialize(links.unionByName(own), "company-links")


def _signed(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with `sig`, `mask` and `len`; only those of companies that some large block holds have the first two.

    A block has the titles of a company and of its guests, itself among them; small ones are paired without signatures.
    """
    titles = nodes.groupBy(F.col("ck").alias("guest")).agg(F.count("*").alias("n"))
    large = links.join(titles, "guest").groupBy("home").agg(F.sum("n").alias("n")).filter(F.col("n") > similar.SMALL_BLOCK).select("home")
    keyed = materialize(links.join(large, "home").select(F.col("guest").alias("ck")).distinct(), "large-companies")
    plain = nodes.join(keyed, "ck", "left_anti").select("*", F.lit(None).cast("bigint").alias("mask"), F.length("tk").alias("len"), F.lit(None).cast("array<int>").alias("sig"))
    if not keyed.isEmpty():
        signed = signatures(nodes.join(keyed, "ck", "left_semi"), "ord", "tk", TITLE_THRESHOLD)
        plain = plain.unionByName(signed)
    return materialize(plain, "title-keys")


def _edges(home: DataFrame, guest: DataFrame, links: DataFrame, guest_after: bool = True, home_after: bool = True) -> DataFrame:
    """Matching pairs between two sets of signed nodes as (earlier, later).

    Pairs in which the guest is the later one count with `guest_after`, those in which the home is the later one
    with `home_after`; inside a company the home is always the earlier one. Only the smaller company of a matched
    couple is copied to the other's key, and a title that several guests of a company share is compared once.
    """
    left = home.select(F.col("ck").alias("home"), F.col("ord").alias("h_ord"), F.col("tk").alias("h_tk"), F.col("sig").alias("h_sig"), F.col("mask").alias("h_mask"), F.col("len").alias("h_len"))
    visits = guest.withColumnRenamed("ck", "guest").join(links, "guest")
    guest_may = F.lit(guest_after) & F.col("guest_later")
    home_may = F.lit(home_after) & F.col("home_later") & (F.col("home") != F.col("guest"))
    right = materialize(visits.groupBy("home", F.col("tk").alias("g_tk")).agg(
        F.first("sig").alias("g_sig"), F.first("mask").alias("g_mask"), F.first("len").alias("g_len"),
        F.max(F.when(guest_may, F.col("ord"))).alias("g_last"), F.min(F.when(home_may, F.col("ord"))).alias("g_first")), "guests")
    some_after = F.coalesce(F.col("g_last") > F.col("h_ord"), F.lit(False))
    some_before = F.coalesce(F.col("g_first") < F.col("h_ord"), F.lit(False))
    cheap = (some_after | some_before) & near_in_size(F.col("h_len"), F.col("g_len"), F.col("h_mask"), F.col("g_mask"), TITLE_THRESHOLD)
    pairs = candidate_pairs(left, right, ["home"], "h_ord", "g_tk", "h_sig", "g_sig", cheap)
    pairs = pairs.filter(near_in_letters(F.col("h_tk"), F.col("g_tk"), F.col("h_len"), F.col("g_len"), TITLE_THRESHOLD))
    open_pairs = materialize(pairs.select("home", "h_ord", "h_tk", "g_tk", some_after.alias("after"), some_before.alias("before")), "open-pairs")
    # Every couple of titles is judged once, whatever companies share it. The ratio is that of the later title against
    # the earlier one; a direction nobody needs is asked with a blank.
    titles = open_pairs.groupBy("h_tk", "g_tk").agg(F.bool_or("after").alias("after"), F.bool_or("before").alias("before"))
    judged = titles.select(
        "h_tk", "g_tk",
        fuzzy_match(F.when(F.col("after"), F.col("g_tk")).otherwise(""), F.col("h_tk"), TITLE_THRESHOLD).alias("guest_matches"),
        fuzzy_match(F.when(F.col("before"), F.col("h_tk")).otherwise(""), F.col("g_tk"), TITLE_THRESHOLD).alias("home_matches"),
    ).filter("guest_matches OR home_matches")
    judged = open_pairs.join(judged, ["h_tk", "g_tk"])
    rows = visits.select("home", F.col("tk").alias("g_tk"), F.col("ord").alias("g_ord"), guest_may.alias("guest_may"), home_may.alias("home_may"))
    later_guest = F.col("guest_matches") & F.col("guest_may") & (F.col("g_ord") > F.col("h_ord"))
    later_home = F.col("home_matches") & F.col("home_may") & (F.col("g_ord") < F.col("h_ord"))
    return judged.join(rows, ["home", "g_tk"]).filter(later_guest | later_home).select(
        F.least("h_ord", "g_ord").alias("earlier"), F.greatest("h_ord", "g_ord").alias("later"))


def duplicate_edges(nodes: DataFrame) -> DataFrame:
    """Every matching pair of nodes, earlier and later (ratio taken as later against earlier)."""
    nodes = materialize(nodes, "nodes")
    links = _company_links(nodes)
    signed = _signed(nodes, links)
    return _edges(signed, signed, links)


def _settle(members: DataFrame, edges: DataFrame) -> DataFrame:
    """First-match survivors over `edges`; members are (ord, sure). Returns (ord, st) with st L, M or U.

    A member that is not sure may have earlier matches outside the set: it can be absorbed but not survive. Each round
    works on the undecided members and the edges between them alone: a sure one without an open earlier match
    survives, whatever matches it is absorbed, and both leave with their edges.
    """
    decided, left = [], None
    while True:
        waiting = edges.groupBy(F.col("later").alias("ord")).agg(F.lit(True).alias("waits"))
        marked = members.join(waiting, "ord", "left").select("ord", "sure", (F.col("sure") & F.col("waits").isNull()).alias("survives"))
        met = (
            edges.join(marked.filter("survives").select(F.col("ord").alias("earlier")), "earlier")
            .groupBy(F.col("later").alias("ord")).agg(F.lit(True).alias("met"))
        )
        st = F.when(F.col("survives"), "L").when(F.col("met"), "M").otherwise("U")
        state = materialize(marked.join(met, "ord", "left").select("ord", "sure", st.alias("st")), "state")
        done = state.filter("st <> 'U'").select("ord", "st")
        decided.append(done)
        members = state.filter("st = 'U'").select("ord", "sure")
        undecided = members.count()
        if undecided in (0, left):
            break
        left = undecided
        edges = materialize(
            edges.join(done.select(F.col("ord").alias("later")), "later", "left_anti")
            .join(done.select(F.col("ord").alias("earlier")), "earlier", "left_anti"), "open-edges")
    out = members.select("ord", F.lit("U").alias("st"))
    for done in decided:
        out = out.unionByName(done)
    return materialize(out, "settled")


def _first_match(edges: DataFrame, leaders: DataFrame) -> DataFrame:
    """(ord, leader): the earliest of the given leaders each node matches."""
    return (
        edges.join(leaders.select(F.col("ord").alias("earlier")), "earlier")
        .groupBy(F.col("later").alias("ord"))
        .agg(F.min("earlier").alias("leader"))
    )


def leader_assignment(nodes: DataFrame) -> DataFrame:
    """(ord, leader) for every node of a written table; survivors lead themselves."""
    links = _company_links(nodes)
    signed = _signed(nodes, links)
    largest = nodes.groupBy("ck").count().agg(F.max("count")).first()[0] or 0
    if largest <= PORTION_NODES:
        edges = materialize(_edges(signed, signed, links), "edges")
        state = _settle(nodes.select("ord", F.lit(True).alias("sure")), edges)
        first = _first_match(edges, state.filter("st = 'L'"))
        return nodes.select("ord").join(first, "ord", "left").select("ord", F.coalesce("leader", "ord").alias("leader"))
    return _assign_in_portions(nodes, links, signed)


def _portions(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give every node the portion of its company it falls in; boundaries are mergeable quantiles."""
    fractions = F.array(*[F.lit(f) for f in _FRACTIONS])
    companies = nodes.groupBy("ck").agg(
        F.count("*").alias("n"), F.percentile_approx("ord", _FRACTIONS, 10_000).alias("cuts")
    )
    first = F.greatest(F.lit(0), F.size(F.filter(fractions, lambda f: f * F.col("n") <= PORTION_NODES)) - 1)
    companies = companies.select("ck", "cuts", first.alias("first"), F.lit(0).alias("at"), F.lit(True).alias("open"))
    companies = materialize(companies.withColumn("top", F.lit(_PORTION_STEPS) - F.col("first")), "companies")
    below = F.size(F.filter("cuts", lambda c: c < F.col("ord")))
    placed = nodes.join(companies, "ck").select(
        "ck", "ord", F.least(F.col("top"), F.greatest(F.lit(0), below - F.col("first"))).alias("portion"),
        F.lit("U").alias("st"), F.lit(None).cast("bigint").alias("leader"),
    )
    return materialize(placed, "placed"), companies


def _assign_in_portions(nodes: DataFrame, links: DataFrame, signed: DataFrame) -> DataFrame:
    placed, companies = _portions(nodes)
    both_ways = links.select("home", "guest").unionByName(links.select(F.col("guest").alias("home"), F.col("home").alias("guest")))
    while True:
        # How far each company, and all companies it can match, are complete in this round.
        reach = companies.select(
            F.col("ck").alias("guest"),
            F.when(F.col("open") & (F.col("at") < F.col("top")), F.get("cuts", F.col("first") + F.col("at"))).alias("reach"),
        )
        limit = both_ways.join(reach, "guest").groupBy(F.col("home").alias("ck")).agg(F.min("reach").alias("limit"))
        portion = materialize(
            placed.filter("st = 'U'").join(companies.select("ck", "at"), "ck").filter("portion <= at")
            .join(limit, "ck")
            .select("ord", F.coalesce(F.col("ord") <= F.col("limit"), F.lit(True)).alias("sure")),
            "portion",
        )
        chosen = signed.join(portion.select("ord"), "ord")
        edges = materialize(_edges(chosen, chosen, links), "edges")
        state = _settle(portion, edges)
        leaders = state.filter("st = 'L'").select("ord")
        signed_leaders = materialize(signed.join(leaders, "ord"), "leaders")
        # Everything outside the portion that does not survive already meets the new survivors.
        rest = signed.join(placed.filter("st <> 'L'").select("ord"), "ord").join(portion.select("ord"), "ord", "left_anti")
        as_guest = _edges(signed_leaders, rest, links, home_after=False)
        as_home = _edges(rest, signed_leaders, links, guest_after=False)
        met = _first_match(edges.unionByName(as_guest).unionByName(as_home), leaders).withColumnRenamed("leader", "met")
        placed = materialize(
            placed.join(leaders.withColumn("new", F.lit(True)), "ord", "left").join(met, "ord", "left").select(
                "ck", "ord", "portion",
                F.when(F.col("new"), "L").when(F.col("met").isNotNull(), "M").otherwise(F.col("st")).alias("st"),
                F.least("leader", "met").alias("leader"),
            ),
            "placed",
        )
        waiting = placed.filter("st = 'U'").groupBy("ck").agg(F.min("portion").alias("next"))
        companies = materialize(
            companies.join(waiting, "ck", "left").select(
                "ck", "cuts", "first", "top",
                F.coalesce(F.greatest("next", "at"), "at").alias("at"),
                F.col("next").isNotNull().alias("open"),
            ),
            "companies",
        )
        if companies.filter("open").isEmpty():
            return placed.select("ord", F.coalesce("leader", "ord").alias("leader"))


def assign_clusters(ordered: DataFrame) -> DataFrame:
    """Add `leader`, the position of the surviving row, to ordered rows with match keys."""
    nodes = materialize(match_nodes(ordered), "nodes")
    keyed = materialize(nodes.join(leader_assignment(nodes), "ord").drop("ord"), "key-leaders")
    return ordered.join(keyed, ["ck", "tk"], "left").withColumn("leader", F.coalesce("leader", "ord"))


def match_classes(rows: DataFrame) -> DataFrame:
    """Written rows (ord, ck, tk) with leader, links and title_ratio: one row each, not one per pair.

    `links` counts the other keys that match the row's own; pairs are counted where they are verified and never
    stored. `title_ratio` is that of the row's title against its leader's (1 for a leader, 0 without match keys).
    """
    clusters = materialize(assign_clusters(rows), "classes")
    nodes = materialize(match_nodes(rows), "nodes")
    edges = duplicate_edges(nodes)
    ends = edges.select(F.explode(F.array("earlier", "later")).alias("node"))
    links = ends.groupBy("node").agg(F.count("*").alias("links"))
    linked = nodes.join(links, nodes["ord"] == links["node"]).select("ck", "tk", "links")
    leads = clusters.filter("ord = leader").select("leader", F.col("tk").alias("_leader_tk"))
    return (
        clusters.join(leads, "leader").join(linked, ["ck", "tk"], "left")
        .withColumn("links", F.coalesce("links", F.lit(0).cast("bigint")))
        .withColumn("title_ratio", F.when(F.col("ck") == "", 0.0).otherwise(ratio(F.col("tk"), F.col("_leader_tk"))))
        .drop("_leader_tk")
    )


@dataclass(frozen=True)
class Deduplicated:
    survivors: DataFrame   # one row per cluster, fields filled, tags and alternates left to the tables below
    clusters: DataFrame    # every input row with ord and leader
    tags: DataFrame        # leader, ord, pos, tag in merged order
    alternates: DataFrame  # leader, ord, source, url, source_id in merge order


def _filled(c: str) -> Column:
    value = F.col(c)
    if c.startswith("salary_m"):
        return F.when(value != 0, value)
    return blank_to_null(value)


def fill_fields(clusters: DataFrame) -> DataFrame:
    """Surviving rows with each empty field taken from the first member that has it.

    min_by merges partial results before the shuffle, so a cluster with most of the rows is no burden. The
    typed date is that of the row whose raw date counts, also where that one could not be read.
    """
    fields = [f for f in FILLED_FIELDS if f in clusters.columns]
    dated = {"posted_date_raw", "posted_date"} <= set(clusters.columns)
    first_of = [F.min_by(_filled(c), F.when(_filled(c).isNotNull(), F.col("ord"))).alias(f"_{c}") for c in fields]
    if dated:
        first_of.append(F.min_by("posted_date", F.when(_filled("posted_date_raw").isNotNull(), F.col("ord"))).alias("_posted_date"))
    first = clusters.filter(F.col("ord") != F.col("leader")).groupBy("leader").agg(*first_of)
    survivors = clusters.filter(F.col("ord") == F.col("leader")).join(first, "leader", "left")
    filled = {c: F.coalesce(_filled(c), F.col(f"_{c}"), F.col(c)) for c in fields}
    if dated:
        own = _filled("posted_date_raw").isNotNull() | F.col("_posted_date_raw").isNull()
        filled["posted_date"] = F.when(own, F.col("posted_date")).otherwise(F.col("_posted_date"))
    return survivors.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in clusters.columns])


def _entries(clusters: DataFrame, more: DataFrame | None, array: str, name: str) -> DataFrame:
    """leader, ord, pos and each entry of an array column, those of later chunks behind the others."""
    rows = clusters.select("leader", "ord", F.posexplode(array).alias("pos", name))
    if more is None:
        return rows
    later = more.select("leader", "ord", "chunk", F.posexplode(array).alias("pos", name))
    place = F.shiftleft(F.col("chunk").cast("long"), 32) + F.col("pos")
    return rows.withColumn("pos", F.col("pos").cast("long")).unionByName(later.select("leader", "ord", place.alias("pos"), name))


def merged_tags(clusters: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """leader, ord, pos, tag: a tag comes from the first row of the cluster that has it.

    Repeats inside that row stay, as they do when lists are appended one member at a time.
    """
    tagged = _entries(clusters, more, "tags", "tag")
    first = tagged.groupBy("leader", "tag").agg(F.min("ord").alias("ord"))
    return tagged.join(first, ["leader", "tag", "ord"]).select("leader", "ord", "pos", "tag")


def alternate_sources(clusters: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """leader, ord, pos, source, url, source_id: what was merged away, in order.

    A survivor's alternates of an earlier stage (array column `alternate_sources`) come first, at its own
    `ord`; those of rows merged away now are not taken over.
    """
    merged = clusters.filter(F.col("ord") != F.col("leader")).select(
        "leader", "ord", F.lit(0).alias("pos"), *[F.coalesce(c, F.lit("")).alias(c) for c in ALTERNATE]
    )
    if "alternate_sources" not in clusters.columns:
        return merged
    earlier = _entries(clusters, more, "alternate_sources", "a").filter(F.col("ord") == F.col("leader"))
    return earlier.select("leader", "ord", "pos", *[F.coalesce(F.col(f"a.{c}"), F.lit("")).alias(c) for c in ALTERNATE]).unionByName(merged)


def from_clusters(clusters: DataFrame, more: DataFrame | None = None) -> Deduplicated:
    """`more`: leader, ord, chunk, tags, alternate_sources of rows whose arrays have further chunks."""
    return Deduplicated(fill_fields(clusters), clusters, merged_tags(clusters, more), alternate_sources(clusters, more))


def deduplicate(df: DataFrame, *position: Column | str) -> Deduplicated:
    """Order, cluster and merge a merged listing set; `position` is each row's place in it.

    Rows of an earlier stage may come in chunks, as `nested` gives them: chunk 0 is the listing, the entries
    of the others follow its own. Chunks belong together when all other columns are equal.
    """
    again = [c for c in ("ord", "leader", "ck", "tk", "priority", "chunk") if c in df.columns]  # of an earlier stage
    if "chunk" not in again:
        return from_clusters(_clustered(df.drop(*[c for c in again if c not in position]), position))
    own = F.struct(*[df[f"`{c}`"] for c in df.columns if c not in ("chunk", "tags", "alternate_sources")])
    marked = df.withColumn("_mark", F.sha2(F.to_json(own), 256))
    kept = marked.filter("coalesce(chunk, 0) = 0").drop(*[c for c in again if c not in position])
    clusters = _clustered(kept, position)
    first = clusters.groupBy("_mark").agg(F.min(F.struct("ord", "leader")).alias("_at")).select("_mark", "_at.*")
    later = marked.filter("chunk > 0").select("_mark", "chunk", "tags", "alternate_sources")
    more = materialize(later.join(first, "_mark").drop("_mark"), "later-chunks")
    return from_clusters(clusters.drop("_mark"), more)


def _clustered(df: DataFrame, position: tuple[Column | str, ...]) -> DataFrame:
    return materialize(assign_clusters(by_source_priority(with_match_keys(df), *position)), "clusters")


def array_chunks(result: Deduplicated, size: int | None = CHUNK) -> DataFrame:
    """leader, chunk, tags, alternate_sources: one row per `chunk` 0, 1, 2... of a cluster.

    No array has more than `size` entries (None: no bound). Entries are numbered by a range sort over all
    clusters, so a cluster with most of the rows is spread out.
    """
    def chunked(entries: DataFrame, value: Column, name: str) -> DataFrame:
        ranked = rank_within(entries, ["leader"], [F.col("ord"), F.col("pos")], "_n")
        numbered = ranked.withColumn("chunk", (F.lit(0) if size is None else F.floor((F.col("_n") - 1) / size)).cast("int"))
        listed = F.sort_array(F.collect_list(F.struct("_n", value.alias("value"))))
        return numbered.groupBy("leader", "chunk").agg(F.transform(listed, lambda x: x["value"]).alias(name))

    tags = chunked(result.tags, F.col("tag"), "tags")
    alternates = chunked(result.alternates, F.struct(*ALTERNATE), "alternate_sources")
    first = result.survivors.select("leader", F.lit(0).alias("chunk"))
    lists = first.join(tags, ["leader", "chunk"], "full").join(alternates, ["leader", "chunk"], "full")
    empty = F.array().cast("array<struct<source:string,url:string,source_id:string>>")
    return (
        lists.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
        .withColumn("alternate_sources", F.coalesce("alternate_sources", empty))
    )


def nested(result: Deduplicated, size: int | None = CHUNK) -> DataFrame:
    """Survivors with `tags` and `alternate_sources` as arrays, for interchange.

    A cluster with more than `size` entries has further rows (`array_chunks`), each with the survivor's columns
    and the next entries.
    """
    return result.survivors.drop("tags", "alternate_sources").join(array_chunks(result, size), "leader")


def _final(survivors: DataFrame) -> tuple[DataFrame, list[Column | str]]:
    """Best score first (none counts as 0), then source priority, then survivor order."""
    keyed = survivors.withColumn("_score", F.coalesce("preliminary_relevance_score", F.lit(0.0))).withColumn("_rank", source_priority("source"))
    return keyed, [F.desc("_score"), "_rank", "ord"]


def final_order(survivors: DataFrame) -> DataFrame:
    keyed, keys = _final(survivors)
    return keyed.orderBy(*keys).drop("_score", "_rank")


def final_position(survivors: DataFrame, name: str = "place") -> DataFrame:
    """The final order as a column, for results that are stored."""
    keyed, keys = _final(survivors)
    return with_position(keyed, *keys, name=name).drop("_score", "_rank")


def dedup_stats(clusters: DataFrame) -> DataFrame:
    survived = F.count_if(F.col("ord") == F.col("leader"))
    return clusters.agg(
        F.count("*").alias("total_input"),
        survived.alias("total_output"),
        (F.count("*") - survived).alias("duplicates_removed"),
    )


def keep_most_detailed(df: DataFrame, *tie_break: Column | str) -> DataFrame:
    """One row per (company, title) without regard to case: the one with most filled detail fields.

    Rows with neither company nor title are left alone. Exact duplicates only. `max_by` merges before the shuffle; the kept row's other columns come back
    through its position, which must be unique.
    """
    nameless = (lowered("company") == "") & (lowered("title") == "")
    named = exact_duplicates_best(df.filter(~nameless), [lowered("company"), lowered("title")], detail_level(), *tie_break)
    return named.unionByName(df.filter(nameless))


DETAIL_FIELDS = ("location", "salary_min", "salary_max", "posted_date", "description_text", "employment_type")


def detail_level() -> Column:
    """How many detail fields a listing fills, then how long its description is."""
    filled = sum(
        F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0) for c in DETAIL_FIELDS
    )
    return F.struct(filled.alias("filled"), F.length(F.coalesce("description_text", F.lit(""))).alias("chars"))


def exact_duplicates_best(df: DataFrame, keys: list[Column], detail: Column, *tie_break: Column | str) -> DataFrame:
    """row_number() = 1 inside each key; Spark keeps one row per key in every map task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(detail), *tie_break)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
