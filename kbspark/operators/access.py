"""Who may see which repository, and how questions find one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import text as X
from kbspark.operators import scoring


#: Users whose public repositories are listed one by one.
MOST_USERS = 10_000


def visible_repos(users: DataFrame, repos: DataFrame, members: DataFrame, include_public: bool = True) -> DataFrame:
    """(user_id, repo_id, via): repositories that each user owns, belongs to, or sees because they are public; each once.

    users: (user_id); repos: (repo_id, owner_id, is_public); members: (repo_id, user_id, role).
    Every user meets every public repository, so MOST_USERS of them may be asked for at a time; repo_roles()
    answers for any number of pairs.
    """
    if include_public and users.limit(MOST_USERS + 1).count() > MOST_USERS:
        raise ValueError(f"ask for {MOST_USERS} users at most, or for the pairs of interest by repo_roles()")
    owned = repos.join(users, F.col("owner_id") == F.col("user_id")).select("user_id", "repo_id", F.lit(0).alias("p"))
    shared = members.join(users, "user_id").select("user_id", "repo_id", F.lit(1).alias("p"))
    rows = owned.union(shared)
    if include_public:
        public = repos.filter("is_public").select("repo_id").crossJoin(F.broadcast(users.select("user_id")))
        rows = rows.union(public.select("user_id", "repo_id", F.lit(2).alias("p")))
    return rows.groupBy("user_id", "repo_id").agg(F.element_at(F.array(F.lit("owner"), F.lit("member"), F.lit("public")), F.min("p") + 1).alias("via"))


def repo_roles(pairs: DataFrame, repos: DataFrame, members: DataFrame) -> DataFrame:
    """pairs (user_id, repo_id) with role: owner, the member's role, viewer of a public one, or null."""
    joined = pairs.join(repos.select("repo_id", "owner_id", "is_public"), "repo_id", "left").join(members.select("repo_id", "user_id", F.col("role").alias("r")), ["repo_id", "user_id"], "left")
    role = F.when(F.col("owner_id") == F.col("user_id"), "owner").otherwise(F.coalesce("r", F.when(F.col("is_public"), "viewer")))
    return joined.select("user_id", "repo_id", role.alias("role"))


def discover(user: int, repos: DataFrame, members: DataFrame, limit: int = 24) -> DataFrame:
    """Public repositories that a user neither owns nor belongs to, the newest first."""
    mine = members.filter(F.col("user_id") == user).select("repo_id")
    return repos.filter(F.col("is_public") & (F.col("owner_id") != user)).join(mine, "repo_id", "left_anti").orderBy(F.desc("updated_at"), "repo_id").limit(limit)


def full_name(owner: Column, slug: Column) -> Column:
    return F.concat_ws("/", owner, slug)


def resolve(refs: DataFrame, users: DataFrame, repos: DataFrame, access: DataFrame) -> DataFrame:
    """refs (user_id, ref) with repo_id and error: bad_name unless it is owner/slug, not_found for what is missing or can't be seen.

    users: (owner_id, username); repos: (repo_id, owner_id, slug); access: (user_id, repo_id).
    """
    parts = F.split("ref", "/")
    named = refs.withColumn("__ok", (F.size(parts) == 2) & (parts[0] != "") & (parts[1] != "")).withColumns({"username": parts[0], "slug": F.try_element_at(parts, F.lit(2))})
    known = repos.join(users, "owner_id").select("username", "slug", F.col("repo_id").alias("__repo"))
    found = named.join(known, ["username", "slug"], "left").join(access.select("user_id", F.col("repo_id").alias("__repo"), F.lit(True).alias("__may")), ["user_id", "__repo"], "left")
    repo = F.when(F.col("__ok") & F.col("__may"), F.col("__repo"))
    return found.select("user_id", "ref", repo.alias("repo_id"), F.when(~F.col("__ok"), "bad_name").when(repo.isNull(), "not_found").alias("error"))


def preselect(queries: DataFrame, repos: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, repo_id, points, rank): the repositories whose names (2 points a word) and descriptions (1) share words with a query.

    queries: (query_id, question); repos: (repo_id, name, description, pos), pos unique. Up to `limit` repositories
    are all candidates in their order; a query without any shared word gets the first ones.
    """
    # sums over words: no pair of a query and a repository is a row, and repositories (and queries) with the same words are scored once
    words = lambda col: F.array_distinct(X.router_tokens(F.col(col)))
    asked = queries.select(F.lit(0).alias("repo_id"), "query_id", F.explode(words("question")).alias("w")).select("repo_id", "query_id", F.xxhash64("w").alias("term"), F.lit(1.0).alias("w"))
    held = repos.select("pos", words("name").alias("n"), words("description").alias("d")).withColumn("all", F.array_union("n", "d"))
    value = F.transform("all", lambda w: F.array_contains("n", w).cast("double") * 2.0 + F.array_contains("d", w).cast("double"))
    named = held.select(F.lit(0).alias("repo_id"), F.col("pos").alias("id"), F.transform("all", lambda w: F.xxhash64(w)).alias("terms"), value.alias("values"), F.lit(None).cast("double").alias("base"))
    points = scoring.top_by_terms(asked, named, limit, collapse=True).select("query_id", F.col("id").alias("pos"), F.col("score").alias("points"))
    few = repos.limit(limit + 1).count() <= limit
    top = points.join(repos.select("repo_id", "pos"), "pos")
    # the rest of the places go to the first repositories: limit + limit of them are enough
    firsts = repos.orderBy("pos").limit(limit * 2).select("repo_id", "pos")
    rest = queries.select("query_id").crossJoin(F.broadcast(firsts)).join(top.select("query_id", "repo_id"), ["query_id", "repo_id"], "left_anti").withColumn("points", F.lit(0.0))
    both = top.select("query_id", "repo_id", "points", "pos").unionByName(rest.select("query_id", "repo_id", "points", "pos"))
    by = ["pos"] if few else [F.desc("points"), "pos"]
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).filter(F.col("rank") <= limit).select("query_id", "repo_id", "points", "rank")


def route(candidates: DataFrame, chosen: DataFrame | None = None, min_confidence: float = 0.5) -> DataFrame:
    """(query_id, repo_id, confidence, error) from candidates (query_id, repo_id, points, rank).

    chosen: a model's choice (query_id, repo_id, confidence); without it the best candidate is taken,
    with the share of the points that it holds. Choices that aren't candidates or aren't confident
    are errors; confidence is brought into 0 to 1.
    """
    if chosen is None:
        share = F.col("points") / F.nullif(F.sum("points").over(Window.partitionBy("query_id")), F.lit(0.0))
        chosen = candidates.withColumn("confidence", F.coalesce(share, F.lit(0.0))).filter("rank = 1").select("query_id", "repo_id", "confidence")
    asked = candidates.select("query_id").distinct()
    known = candidates.select("query_id", "repo_id", F.lit(True).alias("__known"))
    rows = asked.join(chosen, "query_id", "left").join(known, ["query_id", "repo_id"], "left")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    error = F.when(F.col("repo_id").isNull(), "low_confidence").when(F.col("__known").isNull(), "selected_not_in_candidates").when(sure < min_confidence, "low_confidence")
    return rows.select("query_id", F.when(error.isNull(), F.col("repo_id")).alias("repo_id"), sure.alias("confidence"), error.alias("error"))
