"""Capabilities: rule sets that a user registers, files shared out among them, and their facts merged.

A capability is three functions of DataFrames. Projects choose among capabilities by score, files go to the first
chosen one that claims them, and each capability analyses its files of all projects in one job.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .facts import GENERIC_LANGUAGES, KEYS

# Least score, and what a selection may come to.
THRESHOLD = 0.5
ENABLED, EMPTY, DEGRADED = "已启用", "未接管", "已降级"
UNKNOWN = "未识别的项目类型"


@dataclass(frozen=True)
class Capability:
    """detect: files to (project_id, score, reason), one row a project at most; claim: files to KEYS, or a condition on a file's own columns; analyze: owned files to tables of facts by kind, each with project_id.

    Where all claims are conditions, a file's owner follows from it and its project's scores, and no contents are shuffled. A capability that isn't specialized is the fallback: it gets what is left of the generic languages, whatever its score.
    """

    name: str
    detect: Callable[[DataFrame], DataFrame]
    claim: Callable[[DataFrame], DataFrame] | Column
    analyze: Callable[[DataFrame], Mapping[str, DataFrame]]
    specialized: bool = True


@dataclass(frozen=True)
class Run:
    """owners: KEYS, owner (null: nobody's); selections: project_id, capability, score, reason, n_files, status; failures: project_id, capability, error; facts: by capability and kind, in the order of registration."""

    owners: DataFrame
    selections: DataFrame
    failures: DataFrame
    facts: Mapping[str, Mapping[str, DataFrame]]


@dataclass
class Registry:
    """Capabilities in the order of registration, which decides between equal scores."""

    capabilities: list[Capability] = field(default_factory=list)

    def register(self, capability: Capability) -> Capability:
        if any(c.name == capability.name for c in self.capabilities):
            raise ValueError(f"a capability is already called {capability.name}")
        if not capability.specialized and any(not c.specialized for c in self.capabilities):
            raise ValueError("there is a fallback already")
        self.capabilities.append(capability)
        return capability


def detections(files: DataFrame, capabilities: Sequence[Capability]) -> DataFrame:
    """(project_id, capability, rank, specialized, score, reason) of every project and capability."""
    projects, out = files.select("project_id").distinct(), None
    for rank, c in enumerate(capabilities):
        said = c.detect(files).select("project_id", F.col("score").cast("double").alias("score"), "reason")
        part = projects.join(said, "project_id", "left").select("project_id", F.lit(c.name).alias("capability"), F.lit(rank).alias("rank"), F.lit(c.specialized).alias("specialized"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("reason", F.lit("")).alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out


def conditions(capabilities: Sequence[Capability]) -> dict[str, Column] | None:
    """What each capability claims, if that can be told from a file alone."""
    if any(c.specialized and not isinstance(c.claim, Column) for c in capabilities):
        return None
    return {c.name: c.claim if c.specialized else F.col("language").isin(*GENERIC_LANGUAGES) for c in capabilities}


def _chosen(capabilities: Sequence[Capability], detected: DataFrame, threshold: float) -> DataFrame:
    return detected.where(F.col("capability").isin(*(c.name for c in capabilities)) & (~F.col("specialized") | (F.col("score") >= threshold)))


def decide(files: DataFrame, claimed: Mapping[str, Column], chosen: DataFrame) -> DataFrame:
    """files with _owner, by the conditions ``claimed``; a file without a name is nobody's. Files meet one row a project."""
    turn = F.struct((~F.col("specialized")).alias("rest"), (-F.col("score")).alias("score"), "rank", "capability")
    ranked = chosen.groupBy("project_id").agg(F.array_sort(F.collect_list(turn)).alias("_ranked"))
    mine = F.array(*[F.when(condition, F.lit(name)) for name, condition in claimed.items()])
    first = F.get(F.filter("_ranked", lambda x: F.coalesce(F.array_contains(F.array_compact("_claims"), x["capability"]), F.lit(False))), F.lit(0))
    owner = F.when(F.col("relative_path").isNotNull(), first["capability"])
    return files.withColumn("_claims", mine).join(ranked, "project_id", "left").select(*files.columns, owner.alias("_owner"))


def allocate(files: DataFrame, capabilities: Sequence[Capability], detected: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(KEYS, owner): of the capabilities that a project chose and that claim a file the one of highest score, of equals the first registered; else the fallback; else null."""
    if not capabilities:
        return files.select(*KEYS, F.lit(None).cast("string").alias("owner"))
    chosen, claimed = _chosen(capabilities, detected, threshold), conditions(capabilities)
    if claimed is not None:
        return decide(files, claimed, chosen).select(*KEYS, F.col("_owner").alias("owner"))
    claims = None
    for c in capabilities:
        if not c.specialized or isinstance(c.claim, Column):
            held = files.where(c.claim if c.specialized else F.col("language").isin(*GENERIC_LANGUAGES))
        else:
            held = c.claim(files)
        mine = held.select(*KEYS).distinct().withColumn("capability", F.lit(c.name))
        claims = mine if claims is None else claims.unionByName(mine)
    # A project has as many rows of ``chosen`` as there are capabilities, which code bounds.
    best = F.min_by("capability", F.struct(~F.col("specialized"), -F.col("score"), "rank"))
    owned = claims.join(chosen, ["project_id", "capability"]).groupBy(*KEYS).agg(best.alias("owner"))
    return files.select(*KEYS).join(owned, KEYS, "left")


def _owned(contents: DataFrame, files: DataFrame, capabilities: Sequence[Capability], detected: DataFrame | None, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(KEYS, owner) of ``contents``, some of the files, and these with _owner where they have one; both written."""
    claimed = conditions(capabilities) if capabilities else None
    if claimed is not None:
        decided = decide(contents, claimed, _chosen(capabilities, detected, threshold))
        owners = written(decided.select(*KEYS, F.col("_owner").alias("owner")), "owners")
        return owners, written(decided.where("_owner is not null"), "owned")
    # Claims are made on all files, since one may rest on others.
    every = written(allocate(files, capabilities, detected, threshold), "owners")
    known = every.where("owner is not null").select(*KEYS, F.col("owner").alias("_owner")).distinct()
    shared = written(contents.join(known, KEYS).select(*files.columns, "_owner"), "owned")
    return every, shared


def run(files: DataFrame, registry: Registry, threshold: float = THRESHOLD) -> Run:
    """Detect, share out, analyse. ``files`` should be written: it is read once for each capability.

    An analysis that fails, while planned or while it runs, fails its capability: that is noted for each project it had files in,
    its files are shared out among the others, and those that get some analyse anew. There are at most as many rounds as capabilities.
    """
    spark = files.sparkSession
    alive = list(registry.capabilities)
    detected = written(detections(files, alive), "detections") if alive else None
    failures = spark.createDataFrame([], "project_id string, capability string, error string")
    # Contents meet their owners once, those of a failed capability once more; an analysis may read its files many times.
    owners, shared = _owned(files, files, alive, detected, threshold)
    facts: dict[str, dict[str, DataFrame]] = {}
    while True:
        failed = None
        for c in alive:
            if c.name in facts:
                continue
            mine = shared.where(F.col("_owner") == c.name).drop("_owner")
            try:
                facts[c.name] = {kind: written(table, f"facts-{kind}") for kind, table in c.analyze(mine).items()}
            except Exception as error:  # noqa: BLE001 - whatever a user's rules raise fails that capability only
                said = f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"
                failures = failures.unionByName(owners.where(F.col("owner") == c.name).select("project_id").distinct().withColumns({"capability": F.lit(c.name), "error": F.lit(said)}))
                failed = c
                break
        if failed is None:
            break
        alive.remove(failed)
        # No other file's owner changes: it had a better one than the capability that failed.
        lost = shared.where(F.col("_owner") == failed.name).drop("_owner")
        told, moved = _owned(lost, files, alive, detected, threshold)
        if alive and conditions(alive) is None or not alive:
            owners = told
        else:
            owners = owners.where(F.col("owner").isNull() | (F.col("owner") != failed.name)).unionByName(told)
        shared = shared.where(F.col("_owner") != failed.name).unionByName(moved)
        for r in moved.select("_owner").distinct().collect():  # capabilities
            facts.pop(r["_owner"], None)
    return Run(owners, selections(owners, detected, failures, threshold), failures, {c.name: facts[c.name] for c in alive})


def selections(owners: DataFrame, detected: DataFrame | None, failures: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(project_id, capability, score, reason, n_files, status) of what projects chose; a fallback shows only where it has files."""
    if detected is None:
        return owners.sparkSession.createDataFrame([], "project_id string, capability string, score double, reason string, n_files long, status string")
    counts = owners.where("owner is not null").groupBy("project_id", F.col("owner").alias("capability")).agg(F.count(F.lit(1)).alias("n_files"))
    down = failures.select("project_id", "capability", F.lit(True).alias("down")).distinct()
    keys = ["project_id", "capability"]
    both = detected.join(counts, keys, "left").join(down, keys, "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)).cast("long"))
    shown = both.where((F.col("specialized") & (F.col("score") >= threshold)) | (F.col("n_files") > 0) | F.col("down"))
    status = F.when(F.col("down"), DEGRADED).when(F.col("n_files") == 0, EMPTY).otherwise(ENABLED)
    return shown.select(*keys, "score", "reason", "n_files", status.alias("status"))


TAGS = ("project_id", "capability", "rank", "kind")


def merge_facts(facts: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame:
    """One table of all facts: project_id, capability, rank (of the capability), kind, and every column that any of them has.

    A bag: nothing is deduplicated. A column that a table lacks is null there. Columns of one name and several types become
    strings. A fact's own columns named like the tags are kept as own_capability, own_rank, own_kind.
    """
    parts, kinds = [], {}
    for rank, (name, tables) in enumerate(facts.items()):
        for kind, table in tables.items():
            own = {c: f"own_{c}" if c in TAGS[1:] else c for c in table.columns if c != "project_id"}
            parts.append((rank, name, kind, table.select("project_id", *[F.col(f"`{c}`").alias(a) for c, a in own.items()])))
            for column, dtype in parts[-1][3].dtypes:
                kinds.setdefault(column, set()).add(dtype)
    if not parts:
        raise ValueError("there are no facts to merge")
    out = None
    for rank, name, kind, table in parts:
        cast = [F.col(f"`{c}`").cast("string").alias(c) if len(kinds[c]) > 1 else F.col(f"`{c}`") for c in table.columns if c != "project_id"]
        part = table.select("project_id", F.lit(name).alias("capability"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), *cast)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def merge_technologies(projects: DataFrame, said: DataFrame) -> DataFrame:
    """(project_id, technologies): distinct, by the capability that says so first, then by place; UNKNOWN alone where none does.

    projects: project_id; said: (project_id, rank, place, technology).
    """
    first = said.where("technology is not null").groupBy("project_id", "technology").agg(F.min(F.struct("rank", "place")).alias("at"))
    named = first.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "technology"))), lambda x: x["technology"]).alias("technologies"))
    return projects.select("project_id").distinct().join(named, "project_id", "left").withColumn("technologies", F.coalesce("technologies", F.array(F.lit(UNKNOWN))))


def merge_roles(said: DataFrame) -> DataFrame:
    """(project_id, role, relative_path, rank, place): each path of a role once, where it is said first. said: these columns."""
    return said.groupBy("project_id", "role", "relative_path").agg(F.min(F.struct("rank", "place")).alias("at")).select("project_id", "role", "relative_path", "at.*")
