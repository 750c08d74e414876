"""Mode bits, access lists and extended attributes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Permission bits of a mode; the mark and the mask in a record's flags.
PERMISSIONS, SEALED, EPOCH_MASK = 0o7777, 32768, 32767
#: Fixed value: the unit in which clients count a file's space.
STAT_BLOCK = 512


def merged_mode(mode: Column, new: Column) -> Column:
    """The type bits of ``mode`` with the permissions of ``new``."""
    return mode.bitwiseAND(~PERMISSIONS & 0xFFFFFFFF).bitwiseOR(new.bitwiseAND(PERMISSIONS))


def client_attributes(mode: Column, size: Column, seconds: Column) -> dict[str, Column]:
    """What clients see of an inode; a network client's seconds have no sign, so those before 1970 are 0."""
    blocks = F.ceil(size / STAT_BLOCK).cast("long")
    return {
        "perm": mode.bitwiseAND(PERMISSIONS),
        "blocks": blocks,
        "used": blocks * STAT_BLOCK,
        "net_seconds": F.greatest(seconds, F.lit(0)),
    }


def is_sealed(flags: Column) -> Column:
    return flags.bitwiseAND(SEALED) != 0


def epoch_of(flags: Column) -> Column:
    return flags.bitwiseAND(EPOCH_MASK)


def created_mode(mode: Column, umask: Column, default_acl: Column) -> Column:
    """Mode of a new entry: with a default access list (array of tag, perm) its entries mask, otherwise the umask.

    Owner and other bits are limited by the list's own; the group bits by the
    mask entry, or by the group entry where there is no mask.
    """

    def perm(tag: str) -> Column:
        return F.element_at(F.transform(F.filter(default_acl, lambda e: e["tag"] == tag), lambda e: e["perm"]), 1)

    shift = lambda c, n: F.call_function("shiftleft", c, F.lit(n))
    has = F.coalesce(F.size(default_acl), F.lit(0)) > 0
    group = F.coalesce(F.try_element_at(F.transform(F.filter(default_acl, lambda e: e["tag"] == "mask"), lambda e: e["perm"]), F.lit(1)), perm("group"))
    limit = shift(perm("owner"), 6).bitwiseOR(shift(group, 3)).bitwiseOR(perm("other"))
    return F.when(has, mode.bitwiseAND(limit)).otherwise(mode.bitwiseAND(F.bitwise_not(umask)))


def xattrs(entries: Column) -> Column:
    """A map from entries, null where there are none."""
    return F.when(F.size(entries) > 0, F.map_from_entries(entries))


def sorted_entries(attributes: Column) -> Column:
    """A map's entries in key order, fit for hashing and comparing."""
    return F.array_sort(F.map_entries(attributes))
