"""Joining a table of groups or keys back to rows, of which one group may hold a large share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage

#: Keys are broadcast up to so many bytes, at so many bytes a key in a hash table.
KEYS_BYTES, KEY_BYTES = 160 << 20, 80
#: Copies of the group table; a hot group's rows are dealt to so many join keys.
SALTS = 16


def join_groups(rows: DataFrame, groups: DataFrame, key: str, spread: Column, salts: int = SALTS) -> DataFrame:
    """Left join of ``groups`` (unique in ``key``) to ``rows`` on ``key``; null keys find nothing.

    Spark broadcasts the groups if their measured size allows. Else the rows of a
    group are dealt to ``salts`` join keys by a hash of ``spread``, and every group is
    there once for each.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [key, "_salt"], "left").drop("_salt")


def written_keys(keys: DataFrame, label: str = "keys") -> DataFrame:
    """``keys``, a column of ids or digests, written and ready to be joined to whole rows.

    Spark takes a filtered or distinct table to be as large as the one it comes from
    and would shuffle the rows to meet it. Once written, the keys are counted and
    broadcast up to ``KEYS_BYTES`` (about 2 million); only above that do rows move.
    """
    found = stage(keys, label)
    return F.broadcast(found) if found.count() * KEY_BYTES <= KEYS_BYTES else found
