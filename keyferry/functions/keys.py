"""Key to key-group to owner, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyferry.params import NUM_GROUPS, NUM_OWNERS, VALUE_BYTES


def key_hash(key: Column) -> Column:
    """First 32 bits of the key's md5, the same number in every SQL engine."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def key_group(key: Column, num_groups: int = NUM_GROUPS) -> Column:
    """A null key counts as group 0. So the column is never null, and joins on it add no null
    filter, which would compute every hash twice."""
    return F.coalesce(F.pmod(key_hash(key), F.lit(num_groups)).cast("int"), F.lit(0))


def owner_of_group(
    group: Column, num_groups: int = NUM_GROUPS, num_owners: int = NUM_OWNERS
) -> Column:
    """Owners hold contiguous, equal ranges of key-groups."""
    return F.floor(group * num_owners / num_groups).cast("int")


def owner_of_key(
    key: Column, num_groups: int = NUM_GROUPS, num_owners: int = NUM_OWNERS
) -> Column:
    return owner_of_group(key_group(key, num_groups), num_groups, num_owners)


def next_owner(owner: Column, num_owners: int = NUM_OWNERS) -> Column:
    return F.pmod(owner + 1, F.lit(num_owners)).cast("int")


def entry_bytes(key: Column) -> Column:
    """A null key has no bytes of its own, but its value does."""
    return (F.coalesce(F.length(key), F.lit(0)) + VALUE_BYTES).cast("long")
