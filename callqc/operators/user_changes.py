"""User changes folded as if they were applied request by request.

Requests are put in one total order (``seq``, then all columns).  A create that is accepted holds
its id and its username from its own position up to the next delete of its id, wherever that
is, so every create is an interval known beforehand and only its acceptance is open:

* by username, the accepted creates are a chain: the first create once the name is free, then the
  first one after that one's end, and so on.  "First after" is one look-up for every possible
  end, and what can be reached from the head is found by pointer doubling, in a number of rounds
  that is logarithmic in the longest chain;
* by id, two accepted creates must not share a life of the id.  Where they do (an id sent with
  several usernames), nothing before the first such offender of a group of linked names and ids
  can change any more: every later create of a life that began before it is out, whatever its
  name, and the chains of those groups are followed again.

Groups of at most ``FOLD`` creates are folded in order instead, each within a row, which gives the
same answer in one pass.  No step gathers more of a name's or an id's requests than that: look-ups
go by blocks of positions, everything else is an equi-join or a grouped extreme that is combined
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callqc.plans.graph import connected_components
from callqc.plans.ordinal import next_position, ordinal
from callqc.plans.stored import written

USER_FIELDS = ("full_name", "role", "is_active")
DEFAULT_ROLE = "agent"
#: Creates of linked names and ids that one row may hold.
FOLD = 500


def _reached(heads: DataFrame, links: DataFrame) -> DataFrame:
    """Positions ``at`` reached from ``heads`` (``at``) along ``links`` (``at, to``; one per ``at``)."""
    marked, links = written(heads.select("at").distinct(), "chain"), written(links, "links")
    while not links.isEmpty():
        # both now span twice as many steps
        marked = written(marked.unionByName(marked.join(links, "at").select(F.col("to").alias("at"))).distinct(), "chain")
        further = links.select(F.col("at").alias("to"), F.col("to").alias("next"))
        links = written(links.join(further, "to").select("at", F.col("next").alias("to")), "links")
    return marked


def _chains(creates: DataFrame, held: DataFrame) -> DataFrame:
    """Positions of the creates (``at, username, until``) that find their username free.

    ``held`` (``username, until``) are the names taken before the first request.
    """
    taken = held.groupBy("username").agg(F.max(F.coalesce("until", F.lit(-1))).alias("last"), F.min(F.coalesce("until", F.lit(-1))).alias("any"))
    # a name is free from the end of its holder, or from the beginning; never, if that has no end
    free = (creates.select("username").distinct().join(taken, "username", "left")
            .select(F.col("username").alias("key"), F.when(F.col("any") == -1, None).otherwise(F.coalesce("last", F.lit(0))).alias("at"))
            .where("at IS NOT NULL"))
    ends = creates.where("until IS NOT NULL").select(F.col("username").alias("key"), F.col("until").alias("at"))
    events = creates.select(F.col("username").alias("key"), "at")
    after = written(next_position(free.unionByName(ends), events).where("next IS NOT NULL"), "after")
    heads = free.join(after, ["key", "at"]).select(F.col("next").alias("at"))
    possible = after.select(F.col("next").alias("at")).distinct()  # no other create is ever reached
    links = (creates.where("until IS NOT NULL").join(possible, "at", "left_semi").select("at", F.col("username").alias("key"), F.col("until").alias("end"))
             .join(after.select("key", F.col("at").alias("end"), F.col("next").alias("to")), ["key", "end"]).select("at", "to"))
    return _reached(heads, links)


def _labels(creates: DataFrame, held: DataFrame) -> DataFrame:
    """``at, id, username, until, label``: claims with the label of their group, names that ids link."""
    claims = held.select("at", "id", "username", "until").unionByName(creates.select("at", "id", "username", "until"))
    name = F.xxhash64(F.lit("name"), "username")
    shared = written(claims.groupBy("id").agg(F.min("username").alias("low"), F.max("username").alias("high")).where("low <> high").select("id"), "shared")
    if shared.isEmpty():
        return claims.withColumn("label", name)
    # names and ids as numbers: if two should meet, their groups are only looked at together
    edges = claims.join(shared, "id", "left_semi").select(name.alias("a"), F.xxhash64(F.lit("id"), F.col("id").cast("string")).alias("b")).distinct()
    label = connected_components(edges, "a", "b").select(F.col("node").alias("name"), F.col("rep"))
    return written(claims.withColumn("name", name).join(label, "name", "left").withColumn("label", F.coalesce("rep", "name")).drop("name", "rep"), "claims")


def _folded(claims: DataFrame) -> DataFrame:
    """Positions of the accepted creates of small groups: each group's claims in order, in one row."""
    claim = "struct<at:bigint,id:string,username:string,until:bigint>"
    feed = claims.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("at", F.col("id").cast("string").alias("id"), "username", "until"))).alias("feed"))
    # a state is who holds something now, and the positions accepted so far
    good = feed.select(F.explode(F.expr(f"""
        aggregate(feed, named_struct('live', CAST(array() AS array<{claim}>), 'good', CAST(array() AS array<bigint>)),
          (s, e) -> CASE WHEN e.at = 0 OR NOT exists(s.live, x -> (x.id = e.id OR x.username = e.username) AND (x.until IS NULL OR x.until > e.at))
            THEN named_struct('live', concat(filter(s.live, x -> x.until IS NULL OR x.until > e.at), array(e)), 'good', concat(s.good, array(e.at)))
            ELSE s END,
          s -> s.good)""")).alias("at"))
    return good.where("at > 0")


def _accepted(creates: DataFrame, held: DataFrame) -> DataFrame:
    """Positions of the accepted creates."""
    claims = _labels(creates, held)
    sizes = claims.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last")).where("last > 0")
    large = written(sizes.where(F.col("n") > FOLD).select("label"), "large")
    done = _folded(claims.join(sizes.where(F.col("n") <= FOLD).select("label"), "label", "left_semi"))
    if large.isEmpty():
        return done
    of_large = claims.join(large, "label", "left_semi")
    open_, held = written(of_large.where("at > 0"), "open"), of_large.where("at = 0")
    life = ["id", F.coalesce("until", F.lit(-1)).alias("until")]
    before = held.select(*life, F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("label"))
    while True:
        reached = written(open_.join(_chains(open_, held), "at", "left_semi"), "reached")
        lives = (reached.select(*life, "at", "label").unionByName(before).groupBy("id", "until")
                 .agg(F.min("at").alias("first"), F.max("label").alias("label")))
        lives = written(lives, "lives")
        offends = reached.select(*life, "at", "label").join(lives.select("id", "until", "first"), ["id", "until"]).where("at > first")
        limit = written(offends.groupBy("label").agg(F.min("at").alias("limit")), "limit")
        if limit.isEmpty():
            return done.unionByName(reached.select("at"))
        # nothing before a group's first offender changes any more: lives that began there are certain
        certain = lives.join(limit, "label").where("first < limit").select("id", F.col("until").alias("_until"), "first")
        done = written(done.unionByName(reached.join(limit, "label", "left_anti").select("at")), "done")
        open_ = written(
            open_.join(limit.select("label"), "label", "left_semi").withColumn("_until", F.coalesce("until", F.lit(-1)))
            .join(certain, ["id", "_until"], "left").where("first IS NULL OR at <= first").select(*open_.columns), "open")


def apply_user_changes(users: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """qc_users after create / update / delete requests in ``seq`` order; returns (users, rejected).

    * create: ``is_active`` true, ``role`` default ``agent``; rejected while another user has the
      username (``duplicate_username``) or else the id (``duplicate_id``), or without one of them
      (``missing_key``).  A rejected create claims nothing, a delete frees both id and name;
    * update: only the fields sent (non-NULL) change, later requests over earlier ones; one that sends
      nothing is rejected (``empty_update``); unknown ids change nothing;
    * delete: removes the user; unknown ids change nothing.

    Requests of equal ``seq`` go by their other columns; a repeated request is a request of its own.
    Without ``created_at`` in the changes new users get the present time.  Credentials are not
    handled here.  The requests' order and the chains are written to the shared folder.
    """
    columns = ["seq", "op", "id", "username", *USER_FIELDS] + (["created_at"] if "created_at" in changes.columns else [])
    requests = written(ordinal(changes.select(*columns), [F.col("seq")], "at"), "requests")
    key = users.schema["id"].dataType
    creates = requests.where("op = 'create' AND id IS NOT NULL AND username IS NOT NULL").select("at", F.col("id").cast(key).alias("id"), "username")
    present = users.select("id", "username", F.lit(0).cast("long").alias("at"))
    deletes = requests.where("op = 'delete' AND id IS NOT NULL").select(F.col("id").cast(key).alias("key"), "at")
    until = next_position(creates.select(F.col("id").alias("key"), "at").unionByName(present.select(F.col("id").alias("key"), "at")), deletes)
    until = until.select(F.col("key").alias("id"), "at", F.col("next").alias("until"))
    creates = written(creates.join(until, ["id", "at"], "left"), "creates")
    present = written(present.join(until, ["id", "at"], "left"), "present")
    accepted = written(_accepted(creates, present), "accepted")

    # whoever has no end is there after the last request
    living = creates.where("until IS NULL").join(accepted, "at").select("id", "at")
    born = living.join(requests.drop("id"), "at").select(
        "id", "username", "full_name", F.coalesce("role", F.lit(DEFAULT_ROLE)).alias("role"), F.lit(True).alias("is_active"),
        (F.col("created_at") if "created_at" in columns else F.localtimestamp()).cast(users.schema["created_at"].dataType).alias("created_at"),
        F.col("at").alias("_since"))
    kept = users.join(present.where("until IS NULL").select("id"), "id", "left_semi").withColumn("_since", F.lit(0).cast("long"))
    base = kept.select(*users.columns, "_since").unionByName(born, allowMissingColumns=True)
    sends = F.coalesce(*(F.col(f).cast("string") for f in USER_FIELDS)).isNotNull()
    updates = requests.where((F.col("op") == "update") & sends).withColumn("id", F.col("id").cast(key))
    patches = (updates.join(base.select("id", "_since"), "id").where(F.col("at") > F.col("_since")).groupBy("id")
               .agg(*(F.max(F.when(F.col(f).isNotNull(), F.struct("at", f)))[f].alias(f"_new_{f}") for f in USER_FIELDS)))
    after = base.join(patches, "id", "left").select(
        *(F.coalesce(f"_new_{c}", c).alias(c) if c in USER_FIELDS else F.col(c) for c in users.columns))

    # a refused create found its name taken if the last accepted one before it had not ended
    holders = creates.join(accepted, "at").select("username", "at", "until").unionByName(present.select("username", "at", "until"))
    lost = creates.join(accepted, "at", "left_anti")
    last = next_position(lost.select(F.col("username").alias("key"), (-F.col("at")).alias("at")), holders.select(F.col("username").alias("key"), (-F.col("at")).alias("at")))
    last = last.select(F.col("key").alias("username"), (-F.col("at")).alias("at"), (-F.col("next")).alias("_holder"))
    ends = holders.select("username", F.col("at").alias("_holder"), F.coalesce("until", F.lit((1 << 63) - 1)).alias("_end"))
    taken = lost.select("username", "at").join(last, ["username", "at"]).join(ends, ["username", "_holder"]).groupBy("at").agg((F.max("_end") > F.col("at")).alias("_taken"))
    keys = F.col("id").isNull() | F.col("username").isNull()
    refused = (requests.where(F.col("op") == "create").join(accepted, "at", "left_anti").join(taken, "at", "left")
               .select("seq", "op", "id", "username", F.when(keys, F.lit("missing_key")).when(F.col("_taken"), F.lit("duplicate_username"))
                       .otherwise(F.lit("duplicate_id")).alias("reason")))
    rejected = refused.unionByName(
        requests.where((F.col("op") == "update") & ~sends).select("seq", "op", "id", "username", F.lit("empty_update").alias("reason")))
    return after, rejected
