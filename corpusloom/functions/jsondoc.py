"""JSON documents in columns: deep merge, set and remove, by JVM expressions over VARIANT.

A null column is no document; a JSON null is a value like any other. Numbers keep their type and objects their members; the order
of an object's members is by name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of objects within objects that a merge follows; where both documents are deeper, it is an error and never a cut.
DEPTH = 8


def members(doc: Column) -> Column:
    """The members of an object as a map of variants; null for anything else."""
    return F.try_variant_get(doc, "$", "map<string,variant>")


def merged(base: Column, patch: Column, depth: int = DEPTH) -> Column:
    """``base`` with ``patch`` laid over it: members that are objects on both sides merge in turn, all other values of the patch take the
    place of what is there, arrays and nulls too. Where one side is null, the other."""
    old, new = members(base), members(patch)
    if depth == 0:
        both = F.raise_error(F.lit("objects are nested too deep to merge"))
        return F.when(old.isNotNull() & new.isNotNull(), both).otherwise(F.coalesce(patch, base))
    # a value is null here only where its side has no such member
    each = F.map_zip_with(old, new, lambda _, b, p: merged(b, p, depth - 1))
    return F.when(old.isNotNull() & new.isNotNull(), F.to_variant_object(each)).otherwise(F.coalesce(patch, base))


def with_member(doc: Column, path: list[str], value: Column) -> Column:
    """``doc`` with ``value`` (a variant) at a path of names, in place of what is there. Objects on the way must exist, else the document
    stays as it is, as it does if ``value`` is null."""
    name, *rest = path
    own = members(doc)
    if rest:
        inner = F.map_zip_with(own, F.create_map(F.lit(name), F.element_at(own, name)), lambda k, b, _: F.when(k == name, with_member(b, rest, value)).otherwise(b))
        ready = own.isNotNull() & F.map_contains_key(own, name)
    else:
        inner = F.map_zip_with(own, F.create_map(F.lit(name), value), lambda _, b, p: F.coalesce(p, b))
        ready = own.isNotNull() & value.isNotNull()
    return F.when(ready, F.to_variant_object(inner)).otherwise(doc)


def without(doc: Column, *names: str) -> Column:
    """``doc`` without members of its top level; anything but an object stays as it is."""
    own = members(doc)
    kept = F.map_filter(own, lambda k, _: ~k.isin(*names)) if names else own
    return F.when(own.isNotNull(), F.to_variant_object(kept)).otherwise(doc)


def names(doc: Column) -> Column:
    """The names of an object's members, ascending; null for anything else."""
    return F.array_sort(F.map_keys(members(doc)))
