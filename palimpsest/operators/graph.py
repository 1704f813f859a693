"""The relation graph of memories: writing, pruning and expanding edges for all requests at once.

Expansion works on edges seen from either end, so one hop is an equi-join of a frontier with them; budgets are ranks within a
request. Loops run a fixed number of hops, or until components are stable, with written tables in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.checkpoints import forget, materialise
from palimpsest.functions import text

#: Relation types in the order in which they are followed, with the memories that each may add, and the total.
BUDGETS = {"updates": 8, "supports": 8, "contradicts": 6, "related_to": 6}
TOTAL, HOPS, MAX_CONFLICTS = 24, 3, 8
LEAST_WEIGHT, WEIGHT_MARGIN, FRONTIER = 0.2, 0.15, 8
#: Ends of a memory, type and direction that may come before one that a step across entities admits; parts that a hub's ends are thinned in.
AHEAD, SALTS = max(BUDGETS.values()) + 2 * TOTAL, 16
UNDIRECTED, MIRRORED = ["contradicts", "related_to"], ["supports", "contradicts", "related_to"]


def _pair_key() -> Column:
    """What identifies an edge: ends and type; for mirrored relations between memories, in either direction."""
    mirrored = F.col("edge_type").isin(MIRRORED) & (F.col("from_kind") == "memory") & (F.col("to_kind") == "memory")
    a = F.when(mirrored, F.least("from_id", "to_id")).otherwise(F.col("from_id"))
    b = F.when(mirrored, F.greatest("from_id", "to_id")).otherwise(F.col("to_id"))
    return F.struct("memory_space", "edge_type", "to_kind", a.alias("a"), b.alias("b"))


def insertable(edges: DataFrame, proposed: DataFrame, order: list[str]) -> DataFrame:
    """The proposed edges that are new: the first by ``order`` of each identity, if the store has none of it in any direction
    that counts as the same. Applying it twice adds nothing."""
    first = Window.partitionBy("__key").orderBy(*order)
    keyed = proposed.withColumn("__key", _pair_key()).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return keyed.join(edges.select(_pair_key().alias("__key")).distinct(), "__key", "left_anti").select(*proposed.columns)


def normalised(relations: DataFrame, memories: DataFrame, order: list[str]) -> DataFrame:
    """Judged relations (memory_space, from_id, to_id, edge_type, weight, …) that may become edges: weight at least 0.2 (null is
    0), two different memories of the space, ends of undirected types in order; of equal ones the first by ``order``."""
    known = memories.select("memory_space", "memory_id").distinct()
    r = relations.where((F.coalesce("weight", F.lit(0.0)) >= LEAST_WEIGHT) & (F.col("from_id") != F.col("to_id")))
    for end in ("from_id", "to_id"):
        r = r.join(known.withColumnRenamed("memory_id", end), ["memory_space", end], "left_semi")
    undirected = F.col("edge_type").isin(UNDIRECTED)
    low, high = F.least("from_id", "to_id"), F.greatest("from_id", "to_id")
    r = r.select(*relations.columns, F.when(undirected, low).otherwise(F.col("from_id")).alias("__f"), F.when(undirected, high).otherwise(F.col("to_id")).alias("__t"))
    r = r.withColumns({"from_id": F.col("__f"), "to_id": F.col("__t")}).drop("__f", "__t")
    first = Window.partitionBy("memory_space", "from_id", "to_id", "edge_type").orderBy(*order)
    return r.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def sparsified(edges: DataFrame, frontier: DataFrame, ranks: DataFrame | None = None, rank: str | None = None) -> DataFrame:
    """Edges of which each frontier memory keeps one ``related_to``: of the greatest weight (null is 0), then the best candidate
    rank of the other end (a memory without a rank comes last), then the smallest id. An edge between two frontier memories belongs to the one it comes from.

    Ranks come from ``ranks`` (memory_space, memory_id, rank), or are the column ``rank`` of the edges where candidates were ranked
    for each frontier memory by itself."""
    f = frontier.select("memory_space", "memory_id", F.lit(True).alias("in")).distinct()
    e = edges.join(f.withColumnsRenamed({"memory_id": "from_id", "in": "__a"}), ["memory_space", "from_id"], "left")
    e = e.join(f.withColumnsRenamed({"memory_id": "to_id", "in": "__b"}), ["memory_space", "to_id"], "left")
    e = e.withColumn("__of", F.when(F.col("edge_type") == "related_to", F.when(F.col("__a"), F.col("from_id")).when(F.col("__b"), F.col("to_id"))))
    e = e.withColumn("__other", F.when(F.col("__of") == F.col("from_id"), F.col("to_id")).otherwise(F.col("from_id")))
    if ranks is not None:
        e = e.join(ranks.select("memory_space", F.col("memory_id").alias("__other"), F.col("rank").alias("__rank")), ["memory_space", "__other"], "left")
    else:
        e = e.withColumn("__rank", F.col(rank) if rank else F.lit(None).cast("int"))
    best = Window.partitionBy("memory_space", "__of").orderBy(F.desc(F.coalesce("weight", F.lit(0.0))), F.asc_nulls_last("__rank"), "edge_id")
    kept = e.where("__of IS NOT NULL").withColumn("__n", F.row_number().over(best)).where("__n = 1")
    return kept.select(*edges.columns).unionByName(e.where("__of IS NULL").select(*edges.columns))


def connected(links: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex connected with each vertex of the links (a, b), by alternating star steps: every vertex
    hands its larger neighbours to its smallest one, then its smaller ones. Rounds grow with the logarithm of the number of
    vertices; a hub's neighbours are joined with one row, never collected. Vertices are numbered once, so rounds move numbers,
    however long the names are; the root's name is the smallest of its group."""

    def towards_least(df: DataFrame, larger: bool) -> DataFrame:
        both = df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else df
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        joined = both.join(least, "a")
        if larger:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    vertices = links.select(F.col("a").alias("v")).unionByName(links.select(F.col("b").alias("v"))).distinct()
    vertices = materialise(vertices.withColumn("id", F.monotonically_increasing_id()), "vertices")  # written once, so numbers are fixed
    number = lambda end, name: vertices.select(F.col("v").alias(end), F.col("id").alias(name))
    numbered = links.where("a <> b").join(number("a", "x"), "a").join(number("b", "y"), "b")
    now, before = materialise(numbered.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "stars"), None
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
    seen = now.agg(F.count("*"), mark).first()
    while True:
        new = materialise(towards_least(towards_least(now, True), False), "stars")
        forget(before)
        before, now = now, new
        found = now.agg(F.count("*"), mark).first()
        if found == seen:
            break
        seen = found
    placed = vertices.join(now.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    names = placed.groupBy("root").agg(F.min("v").alias("name"))
    return placed.join(names, "root").select("v", F.col("name").alias("root"))


def pruned_components(edges: DataFrame, margin: float = WEIGHT_MARGIN) -> DataFrame:
    """Edges without the weak ``related_to`` of components that have more than one of them: those lighter than the heaviest of
    the component less ``margin`` (null is 0). An edge exactly at the bound stays."""
    related = edges.where("edge_type = 'related_to'")
    vertex = lambda c: F.concat_ws("\t", "memory_space", c)
    roots = connected(related.select(vertex("from_id").alias("a"), vertex("to_id").alias("b")))
    placed = related.withColumn("v", vertex("from_id")).join(roots, "v")
    strength = placed.groupBy("root").agg(F.count("*").alias("n"), F.max(F.coalesce("weight", F.lit(0.0))).alias("most"))
    kept = placed.join(strength, "root").where((F.col("n") <= 1) | (F.coalesce("weight", F.lit(0.0)) >= F.col("most") - margin))
    return kept.select(*edges.columns).unionByName(edges.where("edge_type <> 'related_to' OR edge_type IS NULL"))


def has_markers(metadata: Column) -> Column:
    """Whether record markers in the metadata say anything."""
    markers = F.map_values(F.from_json(F.get_json_object(metadata, "$.record_markers"), "map<string,string>"))
    return F.coalesce(F.exists(markers, lambda v: F.btrim(v) != ""), F.lit(False))


def without_historical_conflicts(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """Edges without the ``contradicts`` of which exactly one end has record markers; an unknown memory has none."""
    m = memories.select("memory_space", "memory_id", has_markers(F.col("metadata")).alias("has"))
    e = edges.join(m.withColumnsRenamed({"memory_id": "from_id", "has": "__a"}), ["memory_space", "from_id"], "left")
    e = e.join(m.withColumnsRenamed({"memory_id": "to_id", "has": "__b"}), ["memory_space", "to_id"], "left")
    no = F.lit(False)
    return e.where((F.col("edge_type") != "contradicts") | (F.coalesce("__a", no) == F.coalesce("__b", no))).select(*edges.columns)


def frontiers(memories: DataFrame, n: int = FRONTIER) -> DataFrame:
    """(memory_space, entity_key, memory_id, position): the newest active memories of every entity, or the newest of all where
    none is active; at most ``n``."""
    w = Window.partitionBy("memory_space", "entity_key")
    active = F.coalesce(F.col("status") == "active", F.lit(False))
    # active ones first, so that the first n of an entity are enough to tell; the limit is pushed below the shuffle
    order = w.orderBy(F.desc("__active"), F.desc_nulls_last("updated_at"), "memory_id")
    first = memories.select("memory_space", "entity_key", "memory_id", "updated_at", active.alias("__active"))
    first = first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
    usable = first.withColumn("__live", F.max("__active").over(w)).where(~F.col("__live") | F.col("__active"))
    return usable.select("memory_space", "entity_key", "memory_id", "position")


def rebuilt_local(edges: DataFrame, touched: DataFrame, judged: DataFrame) -> DataFrame:
    """Edges after the mirrored relations at the ``touched`` memories were replaced by the judged ones."""
    t = touched.select("memory_space", "memory_id").distinct()
    relation = F.col("edge_type").isin(MIRRORED)
    old = edges.where(relation)
    for end in ("from_id", "to_id"):
        old = old.join(t.withColumnRenamed("memory_id", end), ["memory_space", end], "left_anti")
    kept = edges.where(~relation | F.col("edge_type").isNull()).select(*edges.columns).unionByName(old.select(*edges.columns))
    return kept.unionByName(judged.select(*edges.columns))


def _ends(edges: DataFrame) -> DataFrame:
    """Edges between memories, seen from either end: (memory_space, memory_id, other, outgoing, edge_id, edge_type, created_at)."""
    e = edges.where("from_kind = 'memory' AND to_kind = 'memory' AND from_id <> to_id").where(F.col("edge_type").isin(list(BUDGETS)))
    side = lambda near, far, out: e.select("memory_space", F.col(near).alias("memory_id"), F.col(far).alias("other"), F.lit(out).alias("outgoing"), "edge_id", "edge_type", "created_at")
    return side("from_id", "to_id", True).unionByName(side("to_id", "from_id", False))


def _owned_ends(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """``_ends`` with the entity_key of the other end (null for one that does not exist); of parallel edges of one type the first."""
    ends = _ends(edges).groupBy("memory_space", "memory_id", "edge_type", "other", "outgoing").agg(F.min(F.struct("created_at", "edge_id")).alias("first"))
    owned = ends.join(owners.select("memory_space", F.col("memory_id").alias("other"), "entity_key"), ["memory_space", "other"], "left")
    return owned.select("memory_space", "memory_id", "other", "outgoing", "edge_type", "entity_key", "first.created_at", "first.edge_id")


def _first_ends(ends: DataFrame) -> DataFrame:
    """The ends (see ``_owned_ends``) that a step across entities can admit at all.

    A step takes the first memories of a type up to its budget, past those of the anchor's entity, those held, and those that the
    step reaches forwards from another memory; the latter two are at most ``TOTAL`` each. So an end is out of reach if, for every
    entity that could be the anchor's, more than ``AHEAD`` ends of its memory, type and direction that are not of this entity come before it. A hub's
    ends are first thinned in ``SALTS`` parts by the same rule, which holds in each of them, so that no task holds them all.
    """
    near = ["memory_space", "memory_id", "edge_type", "outgoing"]
    out = ends.where("entity_key IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("other"), F.lit(SALTS)))
    for keys in ([*near, "salt"], near):
        w = Window.partitionBy(*keys).orderBy("created_at", "edge_id")
        of_one = F.row_number().over(Window.partitionBy(*keys, "entity_key").orderBy("created_at", "edge_id"))
        out = out.withColumn("__one", of_one).withColumn("__most", F.max("__one").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        out = out.withColumn("__n", F.row_number().over(w)).where(F.col("__n") - F.col("__most") <= AHEAD).drop("__one", "__most", "__n")
    return out.drop("salt")


def _hop(frontier: DataFrame, ends: DataFrame, known: DataFrame, cross: bool) -> DataFrame:
    """One step of all requests. frontier, known: (request, memory_space, anchor, time_intent, memory_id). Returns (request,
    memory_space, anchor, time_intent, memory_id, edge_id, edge_type, place): the memories that the budgets admit, new or not."""
    if cross:
        met = frontier.join(ends, ["memory_space", "memory_id"]).where(F.col("entity_key") != F.col("anchor"))
    else:  # the anchor's own memories, and unknown ones: of a hub's edges to other entities none is met
        of_anchor = ends.where("entity_key IS NOT NULL").withColumnRenamed("entity_key", "anchor")
        met = frontier.join(of_anchor, ["memory_space", "memory_id", "anchor"])
        met = met.unionByName(frontier.join(ends.where("entity_key IS NULL").drop("entity_key"), ["memory_space", "memory_id"]))
    w = Window.partitionBy("request", "edge_id").orderBy(F.desc("outgoing"))  # an edge within the frontier is followed once, forwards
    met = met.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    met = met.join(known.select("request", F.col("memory_id").alias("other"), F.lit(True).alias("__known")), ["request", "other"], "left")
    intent = F.coalesce("time_intent", F.lit(""))
    follow = F.when(intent == "history", F.lit(True)).when(intent.isin("current", "latest"), ~F.col("outgoing")).otherwise(F.col("__known").isNull())
    met = met.where((F.col("edge_type") != "updates") | follow)
    first = met.groupBy("request", "memory_space", "anchor", "time_intent", "edge_type", "other").agg(F.min(F.struct("created_at", "edge_id")).alias("first"))
    within = Window.partitionBy("request", "edge_type").orderBy("first")
    kinds = F.create_map(*[F.lit(x) for i, k in enumerate(BUDGETS) for x in (k, i)])
    limits = F.create_map(*[F.lit(x) for k, n in BUDGETS.items() for x in (k, n)])
    budgeted = first.withColumn("nth", F.row_number().over(within)).where(F.col("nth") <= limits[F.col("edge_type")])
    order = Window.partitionBy("request").orderBy(kinds[F.col("edge_type")], "nth")
    held = known.groupBy("request").agg(F.count("*").alias("held"))
    placed = budgeted.withColumn("place", F.row_number().over(order)).join(held, "request").where(F.col("place") <= TOTAL - F.col("held"))
    return placed.select("request", "memory_space", "anchor", "time_intent", F.col("other").alias("memory_id"), F.col("first.edge_id").alias("edge_id"), "edge_type", "place")


def expanded(seeds: DataFrame, edges: DataFrame, memories: DataFrame, hops: int = HOPS, archived_compat: bool = False) -> DataFrame:
    """(request, memory_space, memory_id, hop, place): the memories that each request reaches from its seeds (request,
    memory_space, anchor, time_intent, memory_id): hop 0 the seeds, 1 over edges within the anchor's entity, 2 and more over
    edges to other entities, new memories only.

    In a step every relation type adds up to its budget, first edges first (time, then id), types one after the other, until
    the request holds 24 memories; a memory that it already holds, or reached over two types, takes a place of the step as
    well. A memory that does not exist counts as the anchor's and is never added; archived ones are added only with
    ``archived_compat``. ``updates`` edges follow the time intent: all for history, to the newer memory for current and
    latest, to memories not yet held otherwise. Edges without a weight count like others.
    """
    key = ["request", "memory_space", "anchor", "time_intent"]
    usable = memories if archived_compat else memories.where("status IS NULL OR status <> 'archived'")
    exists = usable.select("memory_space", "memory_id").distinct()
    ends = materialise(_owned_ends(edges, memories), "ends")
    far = materialise(_first_ends(ends), "far") if hops else ends
    held = materialise(seeds.select(*key, "memory_id").distinct().withColumns({"hop": F.lit(0), "place": F.lit(0)}), "held")
    frontier = held
    for hop in range(1, hops + 2):
        step = _hop(frontier.select(*key, "memory_id"), far if hop > 1 else ends, held.select(*key, "memory_id"), cross=hop > 1)
        added = step.join(exists, ["memory_space", "memory_id"], "left_semi").join(held.select("request", "memory_id"), ["request", "memory_id"], "left_anti")
        added = added.groupBy(*key, "memory_id").agg(F.min("place").alias("place")).withColumn("hop", F.lit(hop))
        new = materialise(held.unionByName(added), "held")
        # the first step across starts from all that is held, the next ones from what the last added
        frontier = new if hop == 1 else new.where(F.col("hop") == hop)
        held = new
        if hop > 1 and frontier.isEmpty():
            break
    return held.select("request", "memory_space", "memory_id", "hop", "place")


def evidence(held: DataFrame, edges: DataFrame) -> DataFrame:
    """(request, observation_id, memory_ids): the observations that the held memories derive from, with these memories in order."""
    d = edges.where("edge_type = 'derived_from' AND to_kind = 'observation'").select("memory_space", F.col("from_id").alias("memory_id"), F.col("to_id").alias("observation_id"))
    found = held.select("request", "memory_space", "memory_id").join(d, ["memory_space", "memory_id"])
    return found.groupBy("request", "observation_id").agg(F.array_sort(F.collect_set("memory_id")).alias("memory_ids"))


def conflicts(held: DataFrame, edges: DataFrame, n: int = MAX_CONFLICTS) -> DataFrame:
    """(request, uncertainty): ``contradicting_memory:id`` for memories that contradict a held one; the first ``n`` by edge."""
    met = held.join(_ends(edges).where("edge_type = 'contradicts'"), ["memory_space", "memory_id"])
    first = met.groupBy("request", "other").agg(F.min(F.struct("created_at", "edge_id")).alias("first"))
    w = Window.partitionBy("request").orderBy("first", "other")
    kept = first.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
    return kept.select("request", F.concat(F.lit("contradicting_memory:"), "other").alias("uncertainty"))


def evidence_roles(held: DataFrame, edges: DataFrame) -> DataFrame:
    """(request, memory_id, role, edge_types): the part that every held memory plays, from the relations among the held ones;
    seeds (hop 0) first, then the strongest relation."""
    near = held.select("request", "memory_space", "memory_id")
    other = near.withColumnRenamed("memory_id", "other")
    among = near.join(_ends(edges), ["memory_space", "memory_id"]).join(other, ["request", "memory_space", "other"], "left_semi")
    types = among.groupBy("request", "memory_id").agg(F.array_sort(F.collect_set("edge_type")).alias("edge_types"))
    out = held.join(types, ["request", "memory_id"], "left").withColumn("edge_types", F.coalesce("edge_types", F.array().cast("array<string>")))
    return out.select("request", "memory_id", _role(F.col("edge_types")).alias("role"), F.array_join("edge_types", ",").alias("edge_types"))


def _role(types: Column) -> Column:
    has = lambda t: F.array_contains(types, t)
    return (
        F.when(F.col("hop") == 0, "seed").when(has("contradicts"), "conflicting").when(has("updates"), "historical_or_updated")
        .when(has("supports"), "supporting").when(has("related_to"), "background_only").otherwise("expanded")
    )


def evidence_payload(held: DataFrame, edges: DataFrame, memories: DataFrame) -> DataFrame:
    """(request, memory_id, status, role, relation_types, relation_edges, text): what a composer is given of every held memory. Its
    relations to other held memories come in the order of their time, then id, each (type, ends, reason, weight) once; types in the
    order in which they first occur. Provenance is no relation. A request holds at most ``TOTAL`` memories, so the arrays are bounded."""
    near = held.select("request", "memory_space", "memory_id", "hop").distinct()
    known = edges.where(F.col("edge_type").isin(list(BUDGETS)) & (F.col("from_kind") == "memory") & (F.col("to_kind") == "memory") & (F.col("from_id") != F.col("to_id")))
    among = near.select("request", "memory_space", F.col("memory_id").alias("from_id")).join(known, ["memory_space", "from_id"])
    among = among.join(near.select("request", "memory_space", F.col("memory_id").alias("to_id")), ["request", "memory_space", "to_id"], "left_semi")
    once = among.groupBy("request", "edge_type", "from_id", "to_id", "reason", "weight").agg(F.min(F.struct("created_at", "edge_id")).alias("at"))
    edge = F.struct("edge_type", "from_id", "to_id", "reason", "weight")
    ends = once.select("request", "at", edge.alias("edge"), F.explode(F.array("from_id", "to_id")).alias("memory_id"))
    told = ends.groupBy("request", "memory_id").agg(F.array_sort(F.collect_list(F.struct("at", "edge"))).alias("l"))
    told = told.select("request", "memory_id", F.col("l")["edge"].alias("relation_edges"))
    out = near.join(told, ["request", "memory_id"], "left").withColumn("relation_types", F.coalesce(F.array_distinct(F.col("relation_edges")["edge_type"]), F.array().cast("array<string>")))
    m = memories.select("memory_space", "memory_id", "status", text.memory_text(F.lit(None).cast("string"), F.col("title"), F.col("summary"), F.col("content")).alias("text"))
    return out.join(m, ["memory_space", "memory_id"]).select("request", "memory_id", "status", _role(F.col("relation_types")).alias("role"), "relation_types", "relation_edges", "text")


def missing_entities(memories: DataFrame, entities: DataFrame) -> DataFrame:
    """(memory_space, entity_key, n_memories): entity keys that memories name and that do not exist in their space."""
    named = memories.where("entity_key IS NOT NULL").groupBy("memory_space", "entity_key").agg(F.count("*").alias("n_memories"))
    return named.join(entities.select("memory_space", "entity_key"), ["memory_space", "entity_key"], "left_anti")


def owned_memories(memories: DataFrame, entities: DataFrame) -> DataFrame:
    """Memories with the ``identity_profile`` of their entity; one whose entity is missing fails the job when it is read, as it must
    not be judged without (``missing_entities`` reports them beforehand)."""
    e = entities.select("memory_space", "entity_key", "identity_profile", F.lit(True).alias("__there"))
    joined = memories.join(e, ["memory_space", "entity_key"], "left")
    said = F.concat(F.lit("missing entity "), F.coalesce("entity_key", F.lit("null")), F.lit(" of memory "), "memory_id")
    return joined.withColumn("identity_profile", F.when(F.col("__there"), F.col("identity_profile")).otherwise(F.raise_error(said).cast(e.schema["identity_profile"].dataType))).drop("__there")


def short_refs(held: DataFrame, kind: str) -> DataFrame:
    """(request, id, ref): short references (m1, m2, …) for the ids (request, id, position) of a request, in the order of their
    first position; ids that differ in case only are one."""
    first = held.where(F.btrim("id") != "").groupBy("request", F.lower("id").alias("__l")).agg(F.min(F.struct("position", "id")).alias("f"))
    nth = F.row_number().over(Window.partitionBy("request").orderBy("f"))
    return first.select("request", F.col("f.id").alias("id"), F.concat(F.lit(kind), nth.cast("string")).alias("ref"))


def restored(cited: DataFrame, refs: DataFrame) -> DataFrame:
    """(request, position, id): cited references with the ids they stand for; unknown ones are dropped."""
    return cited.join(refs, ["request", "ref"]).select("request", "position", "id")


def hot_path_edges(actions: DataFrame) -> DataFrame:
    """(memory_space, from_id, to_kind, to_id, edge_type, reason): the edges that follow at once from resolver actions
    (memory_space, action, observation_id, new_id, target_id)."""
    edge = lambda cond, f, kind, t, type_, reason: F.when(
        cond & F.col(f).isNotNull() & F.col(t).isNotNull(),
        F.struct(F.col(f).alias("from_id"), F.lit(kind).alias("to_kind"), F.col(t).alias("to_id"), F.lit(type_).alias("edge_type"), reason.alias("reason")),
    )
    action = F.col("action")
    reason = F.concat(F.lit("resolver:"), action)
    made = F.array(
        edge(action.isin("create", "coexist", "replace"), "new_id", "observation", "observation_id", "derived_from", reason),
        edge(action == "refresh", "target_id", "observation", "observation_id", "derived_from", reason),
        edge(action == "replace", "new_id", "memory", "target_id", "updates", reason),
    )
    return actions.select("memory_space", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("e")).select("memory_space", "e.*")


def local_share(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """(memory_space, edge_id, is_cross): whether an edge between memories joins two entities; an unknown memory makes none."""
    m = memories.select("memory_space", "memory_id", "entity_key")
    e = edges.where("from_kind = 'memory' AND to_kind = 'memory'").select("memory_space", "edge_id", "from_id", "to_id")
    e = e.join(m.withColumnsRenamed({"memory_id": "from_id", "entity_key": "a"}), ["memory_space", "from_id"], "left")
    e = e.join(m.withColumnsRenamed({"memory_id": "to_id", "entity_key": "b"}), ["memory_space", "to_id"], "left")
    return e.select("memory_space", "edge_id", F.coalesce(F.col("a") != F.col("b"), F.lit(False)).alias("is_cross"))
