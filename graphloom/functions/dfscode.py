"""DFS codes of small pattern graphs: order, minimum code, rightmost path, text forms. Plain Python for the driver.

A code is a tuple of edges (i, j, from_label, edge_label, to_label) over pattern vertices numbered by discovery; an edge is
forward if i < j. Codes here carry all labels. The text form may leave out labels that earlier edges fix (written -1).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

Edge = tuple[int, int, int, int, int]
Code = tuple[Edge, ...]


def is_forward(e: Edge) -> bool:
    return e[0] < e[1]


def is_backward(e: Edge) -> bool:
    return e[0] > e[1]


def growth_key(e: Edge) -> tuple:
    """Order of the edges that may come next: backward ones first, by target and label; forward ones from the deepest vertex."""
    return (0, e[1], e[3], 0) if is_backward(e) else (1, -e[0], e[3], e[4])


def edge_key(e: Edge) -> Edge:
    """Plain order of edges: by ends, then labels."""
    return e


def partial_equal(a: Edge, b: Edge) -> bool:
    """Same ends and edge label, and vertex labels that agree where neither is left out (-1)."""
    agree = lambda x, y: x == y or -1 in (x, y)
    return a[:2] == b[:2] and a[3] == b[3] and agree(a[2], b[2]) and agree(a[4], b[4])


def code_key(code: Code) -> tuple:
    """Shorter codes first, then by edges."""
    return (len(code), code)


def node_count(code: Code) -> int:
    return 1 + max((max(e[0], e[1]) for e in code), default=-1)


def labels(code: Code) -> list[int]:
    out = [-1] * node_count(code)
    for i, j, a, _, b in code:
        out[i] = a if out[i] == -1 else out[i]
        out[j] = b if out[j] == -1 else out[j]
    return out


def with_labels(code: Code) -> Code:
    """Fills labels written -1 from the edges that fix them."""
    have = labels(code)
    return tuple((i, j, have[i], e, have[j]) for i, j, _, e, _ in code)


def with_placeholders(code: Code) -> Code:
    return tuple((i, j, a if k == 0 else -1, e, b if k == 0 or i < j else -1) for k, (i, j, a, e, b) in enumerate(code))


def rightmost_path(code: Code) -> list[int]:
    """Indices of the forward edges from the rightmost vertex back to the root."""
    found_by = {e[1]: k for k, e in enumerate(code) if is_forward(e)}  # a vertex is found by one forward edge
    path, at = [], max(found_by, default=0)
    while at:
        path.append(found_by[at])
        at = code[found_by[at]][0]
    return path


def rightmost_vertices(code: Code) -> list[int]:
    """Pattern vertices on the rightmost path, the rightmost first."""
    path = rightmost_path(code)
    return [code[path[0]][1]] + [code[k][0] for k in path]


def to_graph(code: Code) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Vertex labels and edges (u, v, label)."""
    return labels(code), [(e[0], e[1], e[3]) for e in code]


def min_code_edges(vertex_labels: list[int], edges: list[tuple[int, int, int]]) -> Iterator[Edge]:
    """Edges of the least code of a connected graph, one by one: every embedding of the code so far offers its next edges."""
    adjacent: list[list[tuple[int, int, int]]] = [[] for _ in vertex_labels]
    for k, (u, v, label) in enumerate(edges):
        adjacent[u].append((v, label, k))
        adjacent[v].append((u, label, k))
    starts = {}
    for k, (u, v, label) in enumerate(edges):
        for a, b in ((u, v), (v, u)):
            starts.setdefault((vertex_labels[a], label, vertex_labels[b]), []).append(((a, b), frozenset([k])))
    if not starts:
        return
    first = min(starts)
    state, parent, path = starts[first], {1: 0}, [1, 0]
    yield (0, 1, *first)
    for _ in range(len(edges) - 1):
        deepest, options = path[0], {}
        for placed, used in state:
            for w, label, k in adjacent[placed[deepest]]:
                if k not in used and w in placed and (x := placed.index(w)) in path[1:]:
                    edge = (deepest, x, vertex_labels[placed[deepest]], label, vertex_labels[w])
                    options.setdefault(growth_key(edge), (edge, []))[1].append((placed, used | {k}))
        if not options:
            for placed, used in state:
                for x in path:
                    for w, label, k in adjacent[placed[x]]:
                        if w not in placed:
                            edge = (x, len(placed), vertex_labels[placed[x]], label, vertex_labels[w])
                            options.setdefault(growth_key(edge), (edge, []))[1].append(((*placed, w), used | {k}))
        edge, state = options[min(options)]
        if is_forward(edge):
            parent[edge[1]] = edge[0]
            path = [edge[1]]
            while path[-1] != 0:
                path.append(parent[path[-1]])
        yield edge


def min_dfs_code(vertex_labels: list[int], edges: list[tuple[int, int, int]]) -> Code:
    return tuple(min_code_edges(vertex_labels, edges))


@lru_cache(maxsize=1 << 18)
def is_min(code: Code) -> bool:
    """Whether the code is the least of its graph; stops at the first edge that differs."""
    if len(code) < 2:
        return not code or code[0][2] <= code[0][4]
    return all(a == b for a, b in zip(min_code_edges(*to_graph(code)), code, strict=True))


def format_code(code: Code, placeholders: bool = True, kinds: bool = False) -> str:
    """``(i j from edge to)`` joined by ``;``, with F or B before each edge if kinds."""
    shown = with_placeholders(code) if placeholders else code
    return ";".join(("F" if is_forward(e) else "B") * kinds + "(" + " ".join(map(str, e)) + ")" for e in shown)


def format_compact(code: Code) -> str:
    """The first vertex's label, then for each edge its label and (from F to-label) or (b target)."""
    if not code:
        return ""
    parts = [f"({code[0][2]})"] + [f"{e} ({i}f{b})" if i < j else f"{e} (b{j})" for i, j, _, e, b in code]
    return " ".join(parts)


_EDGE = re.compile(r"([FB]?)\(\s*(-?\d+)\s+(-?\d+)\s+(-?\d+)\s+(-?\d+)\s+(-?\d+)\s*\)")


def parse_code(text: str) -> Code:
    """Reads format_code's forms; missing labels are filled."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(";"))):
        m = _EDGE.fullmatch(part)
        if not m:
            raise ValueError(f"not an edge of a code: {part!r}")
        e = tuple(map(int, m.groups()[1:]))
        if m[1] and (m[1] == "F") != is_forward(e):
            raise ValueError(f"kind and ends disagree: {part!r}")
        out.append(e)
    return with_labels(tuple(out))


def candidates(code: Code, triples: set[tuple[int, int, int]], simple: bool = True) -> list[Edge]:
    """Edges (labels from the frequent triples, both ways) that give a least code when put after the code.

    simple: no second edge between two vertices; else there may be edges of other labels.
    """
    have, verts = labels(code), rightmost_vertices(code)
    root_label, last = have[0], verts[0]
    by_label: dict[int, list[tuple[int, int]]] = {}
    for a, e, b in triples:
        by_label.setdefault(a, []).append((e, b))
    linked: dict[int, set[int]] = {}
    for i, j, _, e, _ in code:
        if last in (i, j):
            linked.setdefault(i + j - last, set()).add(e)
    out = []
    for x in verts[2 if simple else 1 :]:
        for e, b in by_label.get(have[last], ()):
            if b == have[x] and (x not in linked if simple else e not in linked.get(x, ())):
                out.append((last, x, have[last], e, b))
    n = len(have)
    for x in verts:
        out += [(x, n, have[x], e, b) for e, b in by_label.get(have[x], ()) if b >= root_label]
    return [e for e in out if is_min((*code, e))]
