"""History of changing entity attributes, stored as checkpoints and deltas.

`delta_store` turns delivered versions into the list of an entity's state
changes: every `checkpoint_every`-th change holds the whole state, the others
only the attributes that changed. `fold` rebuilds the validity rows by carrying
each attribute forward from the nearest checkpoint. A later delivery is
`appended`: only the entities it names are compared anew, and their changes
make a new generation of the store.

Defined results
---------------
* Rows without an instant have no place in a history and are left out.
* Of several rows of an entity at one instant the one with the highest tie
  breaker (row_id) holds, repeated rows therefore change nothing.
* An action is read without case and outer blanks; null, blank and any word
  but Delete mean Replace.
* A Replace with a null or NaN value is a version whose value is missing.
* Neighbouring states equal at twelve significant digits are one version; the
  first one's value stands for it.
* Null key parts are values like any other. An empty table gives no rows.
  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforetime.functions.numbers import bare, twelve_digits
from aforetime.storage import BLOCK, neighbour, ordered_blocks, small_side, written

DELETED, MISSING, HELD = "deleted", "missing", "held"


def delta_store(
    versions: DataFrame,
    keys: Sequence[str],
    *,
    at: str = "usable_at",
    value: str = "value",
    action: str = "action",
    tie: str = "row_id",
    checkpoint_every: int = 16,
) -> DataFrame:
    """State changes per entity as checkpoints and patches.

    Columns: the keys, `at`, `seq` (number of the change within its block of
    the entity), `is_checkpoint`, `state_patch` and `value_patch` (null where
    the attribute didn't change; always set at a checkpoint) and the block number.
    """
    keys = list(keys)
    kind = (
        F.when(F.lower(bare(F.col(action))) == "delete", F.lit(DELETED))
        .when(F.col(value).isNull() | F.isnan(value), F.lit(MISSING))
        .otherwise(F.lit(HELD))
    )
    instants = (
        versions.where(F.col(at).isNotNull())
        .select(*keys, at, tie, kind.alias("state"), F.when(kind == HELD, F.col(value)).alias("value"))
        .groupBy(*keys, at)
        .agg(F.max_by(F.struct("state", "value"), F.coalesce(F.col(tie), F.lit(-(2**62)))).alias("s"))
        .select(*keys, at, "s.state", "s.value")
    )
    blocks = ordered_blocks(instants, [*keys, at], "history")
    before = neighbour(blocks, keys, [at], ["state", "value"], after=False, name="prev")
    digits, old_digits = twelve_digits(F.col("value")), twelve_digits(F.col("prev.value"))
    changes = before.where(
        F.col("prev").isNull() | (F.col("state") != F.col("prev.state")) | ~digits.eqNullSafe(old_digits)
    )
    run = Window.partitionBy(BLOCK, *keys).orderBy(at)
    seq = F.row_number().over(run)
    full = (seq - 1) % checkpoint_every == 0
    return changes.select(
        *keys,
        at,
        seq.alias("seq"),
        full.alias("is_checkpoint"),
        F.when(full | ~F.col("state").eqNullSafe(F.col("prev.state")), F.col("state")).alias("state_patch"),
        F.when(full | ~digits.eqNullSafe(old_digits), F.struct("value")).alias("value_patch"),
        BLOCK,
    )


def fold(store: DataFrame, keys: Sequence[str], *, at: str = "usable_at", checkpoint_every: int = 16) -> DataFrame:
    """Validity rows (keys, value, is_missing, valid_from, valid_to) from a delta store.

    Patches are folded forward from the nearest checkpoint, so a window never
    spans more than `checkpoint_every` rows; a version's end is the instant of
    the patch after it, null while it is the last one.
    """
    keys = list(keys)
    segment = F.floor((F.col("seq") - 1) / checkpoint_every)
    forward = Window.partitionBy(BLOCK, *keys, segment).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    folded = neighbour(store, keys, [at], [at], after=True, name="_next").select(
        *keys,
        F.col(at).alias("valid_from"),
        F.col(f"_next.{at}").alias("valid_to"),
        F.last("state_patch", ignorenulls=True).over(forward).alias("state"),
        F.last("value_patch", ignorenulls=True).over(forward)["value"].alias("value"),
    )
    return folded.where(F.col("state") != DELETED).select(
        *keys, "value", (F.col("state") == MISSING).alias("is_missing"), "valid_from", "valid_to"
    )


def state_at(store: DataFrame, keys: Sequence[str], when: Column, *, at: str = "usable_at") -> DataFrame:
    """(keys, value, is_missing, valid_from) of every entity that has a version at the instant `when`.

    Only the patches since the entity's nearest checkpoint are folded.
    """
    keys = list(keys)
    known = store.where(F.col(at) <= when)
    names = [f"_k{i}" for i in range(len(keys))]
    nearest = known.where("is_checkpoint").groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(
        F.max(at).alias("_from")
    )
    same = F.col(at) >= F.col("_from")
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    patches = known.join(nearest, same).select(*keys, at, "state_patch", "value_patch")
    last = lambda patch: F.max_by(patch, F.when(F.col(patch).isNotNull(), F.col(at)))
    folded = patches.groupBy(*keys).agg(
        last("state_patch").alias("state"), last("value_patch")["value"].alias("value"), F.max(at).alias("valid_from")
    )
    return folded.where(F.col("state") != DELETED).select(*keys, "value", (F.col("state") == MISSING).alias("is_missing"), "valid_from")


def appended(
    generations: Sequence[DataFrame], versions: DataFrame, delivered: DataFrame, keys: Sequence[str], *,
    checkpoint_every: int = 16, **columns: str,
) -> list[DataFrame]:
    """The generations of a store (the first one a written delta_store) after a delivery.

    `versions` is the log of all versions, those of `delivered` included. An
    entity lies whole in one generation, so that late versions fall between
    old ones: the delivery's entities are taken out of the generations so far
    and stored anew from their part of the log. The others aren't read from
    the log or compared again. Each delivery adds an anti join per generation
    to the plan; a new delta_store over the log ends that.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    touched = delivered.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).distinct()
    touched = small_side(written(touched, "touched"))
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    own = versions.join(touched, same, "left_semi")
    newest = written(delta_store(own, keys, checkpoint_every=checkpoint_every, **columns), "deltas")
    return [*[g.join(touched, same, "left_anti") for g in generations], newest]


def fold_all(generations: Sequence[DataFrame], keys: Sequence[str], **options) -> DataFrame:
    """The validity rows of all generations, each folded alone."""
    return reduce(DataFrame.unionByName, [fold(g, keys, **options) for g in generations])


def history(versions: DataFrame, keys: Sequence[str], *, checkpoint_every: int = 16, **columns: str) -> DataFrame:
    """delta_store, written to the shared folder, and fold."""
    store = written(delta_store(versions, keys, checkpoint_every=checkpoint_every, **columns), "deltas")
    return fold(store, keys, at=columns.get("at", "usable_at"), checkpoint_every=checkpoint_every)
