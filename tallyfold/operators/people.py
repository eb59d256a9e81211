"""People, identities and children of a meeting: writes as functions over a mapping of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns that hold a person's name, by table; a parameter of rename_person.
NAMED = {
    "speakers": ["name"],
    "entities": ["name"],
    "relations": ["subject", "object"],
    "commitments": ["owner"],
    "decisions": ["decided_by"],
    "open_questions": ["owner"],
}


def _unknown(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such column: {', '.join(missing)}")


def add_people(people: DataFrame, aliases: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """people (canonical, role) and aliases (alias, canonical) with new (canonical, aliases array, role, pos) added.

    Blank names are dropped. A role that is given replaces the old one, a null one doesn't. Every name
    is an alias of itself; aliases are trimmed and lower-cased, the last row (by pos) that claims one has it.
    """
    rows = new.withColumn("canonical", F.trim("canonical")).where("canonical <> ''")
    last = rows.groupBy("canonical").agg(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("pos"))).alias("_role"))
    people = people.join(last, "canonical", "full").select("canonical", F.coalesce("_role", "role").alias("role"))
    claimed = rows.select("canonical", "pos", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    claimed = claimed.withColumn("alias", F.lower(F.trim("alias"))).where("alias <> ''").groupBy("alias").agg(F.max_by("canonical", "pos").alias("_canonical"))
    aliases = aliases.join(claimed, "alias", "full").select("alias", F.coalesce("_canonical", "canonical").alias("canonical"))
    return people, aliases


def renamed(name: Column | str, merges: Mapping[str, str]) -> Column:
    """The name after the merges (old -> new); blank and self merges change nothing."""
    real = {a.strip(): b.strip() for a, b in merges.items() if a.strip() and b.strip() and a.strip() != b.strip()}
    col = F.col(name) if isinstance(name, str) else name
    if not real:
        return col
    table = F.create_map(*(F.lit(x) for pair in real.items() for x in pair))
    return F.coalesce(F.try_element_at(table, col), col)


def rename_person(tables: Mapping[str, DataFrame], merges: Mapping[str, str], named: Mapping[str, Sequence[str]] = NAMED, keys: Mapping[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    """The tables with names rewritten in all of `named`; where `keys` are given, rows that became equal in them are one."""
    out = dict(tables)
    for name, columns in named.items():
        if name in out:
            _unknown(out[name], columns)
            df = out[name].withColumns({c: renamed(c, merges) for c in columns})
            out[name] = df.dropDuplicates(list(keys[name])) if keys and name in keys else df
    return out


def merge_aliases(people: DataFrame, aliases: DataFrame, merges: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """people without the merged ones; their aliases, and their names, now mean the one merged into."""
    spark = people.sparkSession
    real = [(a.strip(), b.strip()) for a, b in merges.items() if a.strip() and b.strip() and a.strip() != b.strip()]
    gone = spark.createDataFrame(real, "old string, new string")
    aliases = aliases.withColumn("canonical", renamed("canonical", merges))
    own = gone.select(F.explode(F.array("old", "new")).alias("alias"), F.col("new").alias("canonical")).withColumn("alias", F.lower("alias")).distinct()
    aliases = aliases.join(own.select("alias"), "alias", "left_anti").unionByName(own)
    people = people.join(gone.select(F.col("old").alias("canonical")), "canonical", "left_anti")
    added = gone.select(F.col("new").alias("canonical")).distinct().join(people.select("canonical"), "canonical", "left_anti")
    return people.unionByName(added, allowMissingColumns=True), aliases


def forget(samples: DataFrame, matches: DataFrame, people: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Voice samples (person) of the people go, and pending matches no longer name them."""
    named = F.col("best").isin(*people) if people else F.lit(False)
    gone = F.col("person").isin(*people) if people else F.lit(False)
    return samples.where(~F.coalesce(gone, F.lit(False))), matches.withColumns({c: F.when(~F.coalesce(named, F.lit(False)), F.col(c)) for c in ("best", "best_score") if c in matches.columns})


def move_samples(samples: DataFrame, matches: DataFrame, merges: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Samples and resolved matches (resolved_as) of merged people belong to the one merged into."""
    return samples.withColumn("person", renamed("person", merges)), matches.withColumn("resolved_as", renamed("resolved_as", merges))


def delete_meetings(tables: Mapping[str, DataFrame], gone: DataFrame, cascade: Sequence[str], detach: Sequence[str], key: str = "meeting_id") -> dict[str, DataFrame]:
    """The tables without rows of the gone meetings (key); in those of `detach` the key becomes null instead."""
    ids, out = gone.select(F.col(key).alias("_gone")).distinct(), dict(tables)
    for name in cascade:
        out[name] = out[name].join(ids, F.col(key) == F.col("_gone"), "left_anti")
    for name in detach:
        df = out[name].join(ids, F.col(key) == F.col("_gone"), "left")
        out[name] = df.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")
    return out


def canonical_triples(entities: DataFrame, relations: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entities (meeting_id, name, kind) and relations (meeting_id, subject, predicate, object) under canonical names.

    Persons by alias; both ends of a relation by the meeting's own persons (without case), else by
    alias, else trimmed.
    """
    a = aliases.select(F.col("alias").alias("_a"), F.col("canonical").alias("_c"))
    named = entities.join(a, (F.col("kind") == "person") & (F.lower(F.trim("name")) == F.col("_a")), "left")
    named = named.withColumn("name", F.when(F.col("kind") == "person", F.coalesce("_c", F.trim("name"))).otherwise(F.col("name"))).drop("_a", "_c")
    mine = named.where("kind = 'person'").groupBy(F.col("meeting_id").alias("_m"), F.lower("name").alias("_l")).agg(F.min("name").alias("_n"))
    out = relations
    for end in ("subject", "object"):
        own = mine.select(*(F.col(c).alias(f"{c}_") for c in ("_m", "_l", "_n")))
        out = out.join(own, (F.col("meeting_id") == F.col("_m_")) & (F.lower(end) == F.col("_l_")), "left")
        out = out.join(a, F.lower(F.trim(end)) == F.col("_a"), "left")
        out = out.withColumn(end, F.coalesce("_n_", "_c", F.trim(end))).drop("_m_", "_l_", "_n_", "_a", "_c")
    return named, out
