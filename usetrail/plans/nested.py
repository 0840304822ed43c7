"""Uses, declarations and scopes of groups that fit a task, as lists: what every use means.

The same sweep as `operators.symbols.resolve_scoped`, on arrays of numbers: many groups are
done in one pass, and only numbers are sorted, never names or rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Uses, declarations and scopes taken at once, unless one group has more.
ENTRIES = 1 << 16
NONE = np.iinfo(np.int64).min
CROSSING = "a declaration is first seen inside a deeper scope that declares "


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers, and where they are not NULL."""
    return pc.fill_null(column, NONE).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _codes(*columns: pa.Array) -> tuple[list[np.ndarray], int]:
    """Equal numbers for equal values, NULL being a value, over all columns; how many there are."""
    coded = pa.concat_arrays([c.cast(columns[0].type) for c in columns]).dictionary_encode(null_encoding="encode")
    cuts = np.cumsum([len(c) for c in columns])[:-1]
    return np.split(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), cuts), len(coded.dictionary)


def _ranks(column: pa.Array) -> np.ndarray:
    """The place of each value among the distinct ones, NULL first."""
    coded = column.dictionary_encode(null_encoding="encode")
    ranks = pc.rank(coded.dictionary, null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)
    return ranks.astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]


def _homes(decls: np.ndarray, scopes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a declaration and a scope with equal keys; a scope that comes twice counts twice."""
    order = np.argsort(scopes, kind="stable")
    first, end = (np.searchsorted(scopes[order], decls, side) for side in ("left", "right"))
    times = end - first
    pairs = np.repeat(np.arange(len(decls)), times)
    within = np.arange(len(pairs)) - np.repeat(np.cumsum(times) - times, times)
    return pairs, order[np.repeat(first, times) + within]


def _swept(key: np.ndarray, pos: np.ndarray, turn: np.ndarray, depth: np.ndarray, decl: np.ndarray) -> np.ndarray:
    """The order by all five. What ties in all of them is equal, so it may come either way."""
    low = int(pos.min())
    spans = [int(key.max()) + 1, int(pos.max()) - low + 1, 3, int(depth.max()) + 1]
    if spans[0] * spans[1] * spans[2] * spans[3] >= 1 << 63:
        return np.lexsort((decl, depth, turn, pos, key))
    packed = ((key * spans[1] + (pos - low)) * 3 + turn) * spans[3] + depth
    order = np.argsort(packed)
    tied, of = packed[order], decl[order]
    if np.any((tied[1:] == tied[:-1]) & (of[1:] < of[:-1])):
        return np.lexsort((decl, packed))
    return order


def _last(wanted: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The last wanted place at or before each, in its own group; -1 for none."""
    last = np.maximum.accumulate(np.where(wanted, np.arange(len(wanted)), -1))
    return np.where((last >= 0) & (group[last] == group), last, -1)


def _meant(use: pa.Array, decl: pa.Array, scope: pa.Array) -> tuple:
    """`_listed` of rows that are lists of uses, declarations and scopes."""
    rows = [np.repeat(np.arange(len(x)), pc.list_value_length(x).to_numpy(zero_copy_only=False)) for x in (use, decl, scope)]
    use, decl, scope = (x.flatten() for x in (use, decl, scope))
    (name, decl_name), names = _codes(use.field("name"), decl.field("name"))
    (home, decl_home), homes = _codes(scope.field("scope_id"), decl.field("scope_id"))
    pos, asked = _numbers(use.field("pos"))
    opened, seen = _numbers(decl.field("pos"))
    closed, ends = _numbers(scope.field("end_pos"))
    ids, known = _numbers(decl.field("decl_id"))
    depth, deep = _ranks(scope.field("depth")), scope.field("depth").is_valid().to_numpy(zero_copy_only=False)

    # uses, then openings, then closings
    uses = np.flatnonzero(asked)
    at_home = np.flatnonzero(seen & decl.field("scope_id").is_valid().to_numpy(zero_copy_only=False))
    ends = np.flatnonzero(ends)
    owner, inside = _homes((rows[1] * homes + decl_home)[at_home], (rows[2] * homes + home)[ends])
    owner, inside = at_home[owner], ends[inside]
    live = opened[owner] <= closed[inside]
    owner, inside = owner[live], inside[live]
    if not len(owner) or not len(uses):
        return _listed(use, scope, rows[0], *[np.zeros(0, np.int64)] * 3)
    n, m = len(uses), len(owner)
    edge = (rows[1] * names + decl_name)[owner]
    key = np.concatenate([(rows[0] * names + name)[uses], edge, edge])
    nothing = np.zeros(n, np.int64)
    order = _swept(
        key, np.concatenate([pos[uses], opened[owner], closed[inside]]),
        np.repeat(np.array([1, 0, 2]), [n, m, m]),
        np.concatenate([nothing, depth[inside], np.zeros(m, np.int64)]),
        np.concatenate([nothing, ids[owner], np.zeros(m, np.int64)]),
    )
    # a key's steps add up to nothing, so the sum over all is the sum of the key
    level = np.cumsum(np.repeat(np.array([0, 1, -1]), [n, m, m])[order])
    key = key[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) * (int(level.max()) + 1) + level
    is_open = (order >= n) & (order < n + m)
    # an opening also asks for the one below it, to see that that is no deeper
    opens = np.flatnonzero(is_open)
    asks, below = np.flatnonzero((order < n) & (level > 0)), opens[level[opens] > 1]
    place = np.concatenate([opens, asks, below])
    group = np.concatenate([group[opens], group[asks], group[below] - 1])
    kind = np.repeat(np.array([0, 1, 2]), [len(opens), len(asks), len(below)])
    bits = len(order).bit_length()
    if (int(group.max()) + 1) << bits < 1 << 61:
        packed = np.sort((group << bits | place) << 2 | kind)
        kind, place, group = packed & 3, packed >> 2 & (1 << bits) - 1, packed >> (bits + 2)
    else:
        again = np.lexsort((place, group))
        kind, place, group = kind[again], place[again], group[again]
    event = order[place]
    opening, is_open = np.where(kind == 1, 0, event - n), kind == 0
    of_decl = _last(is_open & known[owner[opening]], group)
    of_depth = of_decl if known.all() and deep.all() else _last(is_open & deep[inside[opening]], group)
    asks, checks = np.flatnonzero((kind == 1) & (of_decl >= 0)), np.flatnonzero((kind == 2) & (of_depth >= 0))
    mine = inside[opening[checks]]
    crossing = checks[deep[mine] & (depth[inside[opening[of_depth[checks]]]] > depth[mine])]
    if len(crossing):
        raise ValueError(CROSSING + str(decl.field("name")[int(owner[opening[crossing[0]]])]))
    # back in the order of the uses
    to = np.full(len(use), -1)
    to[uses[event[asks]]] = asks
    found = np.flatnonzero(to >= 0)
    to = to[found]
    at = of_depth[to]
    return _listed(use, scope, rows[0], found, ids[owner[opening[of_decl[to]]]], np.where(at >= 0, inside[opening[at]], -1))


def _listed(use: pa.Array, scope: pa.Array, row: np.ndarray, found: np.ndarray, ids: np.ndarray, home: np.ndarray) -> tuple:
    """Row, name, position, declaration and depth of the uses found, in the order of the uses."""
    at = pa.array(found)
    depth = scope.field("depth").take(pa.array(home, mask=home < 0))
    return row[found], [use.field("name").take(at), use.field("pos").take(at), pa.array(ids, pa.int64()), depth]


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `ENTRIES` entries, or one row."""
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and held + size > ENTRIES:
            yield start, row
            start, held = row, 0
        held += size
    if len(sizes):
        yield start, len(sizes)


def answered(on: list[str], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the uses of each row's list mean: (on.., name, pos, decl_id, depth), a row per use that means something.

    A row has _uses(name, pos), _decls(name, pos, decl_id, scope_id), _scopes(scope_id, depth, end_pos). Rows do not mix.
    """
    for batch in batches:
        lists = [batch.column(c) for c in ("_uses", "_decls", "_scopes")]
        sizes = sum(pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
        for start, end in _parts(sizes):
            row, columns = _meant(*(x.slice(start, end - start) for x in lists))
            keys = [batch.column(c).take(pa.array(row + start)) for c in on]
            yield pa.RecordBatch.from_arrays([*keys, *columns], names=[*on, "name", "pos", "decl_id", "depth"])
