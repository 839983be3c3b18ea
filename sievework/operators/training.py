"""Training sets from saved groups and labels: splits, candidate lists, records, a manifest and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model import hash_share, training_record


def _place(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def labelled_groups(photos: DataFrame, labels: DataFrame, locked: DataFrame, validation: float = 0.15) -> DataFrame:
    """A row a group of two photos or more: dataset, grp, photos, labelled, kind (unlabelled, single, multi) and split.

    photos: dataset, grp, id, stem; labels: dataset, stem (matched without case); locked: dataset, grp, the groups kept
    for the last test. Other groups are train or validation by the hash of dataset and group; unlabelled ones have none.
    """
    named = labels.select("dataset", F.lower("stem").alias("_s")).distinct().withColumn("_y", F.lit(True))
    marked = photos.withColumn("_s", F.lower("stem")).join(named, ["dataset", "_s"], "left")
    groups = marked.groupBy("dataset", "grp").agg(F.count(F.lit(1)).alias("photos"), F.count("_y").alias("labelled")).filter("photos >= 2")
    kind = F.when(F.col("labelled") == 0, "unlabelled").when(F.col("labelled") == 1, "single").otherwise("multi")
    share = min(0.5, max(0.0, validation))
    part = F.when(hash_share(F.concat_ws("|", "dataset", "grp")) < share, "validation").otherwise("train")
    kept = locked.select("dataset", "grp").distinct().withColumn("_l", F.lit(True))
    return groups.join(kept, ["dataset", "grp"], "left").select("dataset", "grp", "photos", "labelled", kind.alias("kind"), F.when(kind == "unlabelled", None).when(F.col("_l"), "test").otherwise(part).alias("split"))


def examples(photos: DataFrame, labels: DataFrame, groups: DataFrame, most: int = 4, permutations: int = 2) -> DataFrame:
    """(dataset, grp, split, permutation, candidates, best): the lists of candidates to learn and to test on.

    photos: dataset, grp, id, stem, name, rank (0: none), score; groups: see labelled_groups. A list to learn on has the one
    labelled photo of its group and the best of the others, ``most`` in all; groups with several labels are left out.
    It is put in an order by hash, which a permutation turns by one place; validation has one. A list to test on has all
    labelled photos first. best are the labelled ones among the candidates, in their order.
    """
    most = max(2, most)
    named = labels.select("dataset", F.lower("stem").alias("_s")).distinct().withColumn("_y", F.lit(True))
    wanted = groups.filter("split = 'test' or kind = 'single'").select("dataset", "grp", "split", "labelled")
    held = photos.join(wanted, ["dataset", "grp"]).withColumn("_s", F.lower("stem")).join(named, ["dataset", "_s"], "left").withColumn("_y", F.coalesce("_y", F.lit(False)))
    order = [F.desc("_y"), F.when(F.col("rank") > 0, F.col("rank")).otherwise(1_000_000), F.desc("score"), F.lower("name"), F.col("id")]
    w = Window.partitionBy("dataset", "grp")
    limit = F.when(F.col("split") == "test", F.greatest(F.lit(most), F.col("labelled"))).otherwise(most)
    chosen = held.select("*", F.row_number().over(w.orderBy(*order)).alias("_n")).filter(F.col("_n") <= limit)
    place = F.when(F.col("split") == "test", _place(F.col("dataset"), F.col("grp"), F.lit("holdout"), F.col("id"))).otherwise(_place(F.col("dataset"), F.col("grp"), F.col("id")))
    lists = chosen.groupBy("dataset", "grp", "split").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), "id", F.col("_y").alias("y")))).alias("c"))
    turns = F.when(F.col("split") == "train", F.lit(permutations)).otherwise(1)
    each = lists.select("dataset", "grp", "split", "c", F.explode(F.sequence(F.lit(0), turns - 1)).alias("permutation"))
    by = F.col("permutation") % F.size("c")
    turned = each.withColumn("c", F.concat(F.slice("c", by + 1, F.size("c")), F.slice("c", F.lit(1), by)))
    return turned.select("dataset", "grp", "split", "permutation", F.col("c.id").alias("candidates"), F.transform(F.filter("c", lambda x: x["y"]), lambda x: x["id"]).alias("best"))


def counts(groups: DataFrame) -> DataFrame:
    """A row a dataset: groups by kind and by split."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    learned = lambda v: F.count_if((F.col("split") == v) & (F.col("kind") == "single"))
    return groups.groupBy("dataset").agg(n("kind", "unlabelled").alias("unlabelled"), n("kind", "single").alias("single"), n("kind", "multi").alias("multi"), learned("train").alias("train"), learned("validation").alias("validation"), n("split", "test").alias("test"))


def missing_locked(locked: DataFrame, groups: DataFrame) -> DataFrame:
    """Locked groups that don't come into the test, for want of photos or labels; a set that lacks any isn't to be used."""
    return locked.select("dataset", "grp").distinct().join(groups.filter("split = 'test'"), ["dataset", "grp"], "left_anti")


def write_training_set(photos: DataFrame, labels: DataFrame, locked: DataFrame, prompt: Column, folder: str, validation: float = 0.15, most: int = 4, permutations: int = 2) -> None:
    """train and validation records as JSON lines, the manifest of all lists, the held-out lists and the counts, below folder.

    prompt: the text of a list, from the columns of examples(). An error, before anything is written, where a locked
    group is missing.
    """
    groups = labelled_groups(photos, labels, locked, validation)
    lost = missing_locked(locked, groups).limit(10).collect()
    if lost:
        raise ValueError(f"locked groups that are not in the test: {sorted((r['dataset'], r['grp']) for r in lost)}")
    lists = examples(photos, labels, groups, most, permutations)
    answer = F.to_json(F.struct(F.col("best")[0].alias("best")))
    for split in ("train", "validation"):
        lists.filter(F.col("split") == split).select(training_record(prompt, answer).alias("value")).write.text(f"{folder}/{split}")
    lists.filter("split != 'test'").write.json(f"{folder}/manifest")
    lists.filter("split = 'test'").write.json(f"{folder}/holdout")
    counts(groups).write.json(f"{folder}/summary")
