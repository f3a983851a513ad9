"""Node tables and results as text: trees, waterfalls, flame graphs, summaries. Driver work on one request."""

from __future__ import annotations

from collections import defaultdict
from typing import Any

from pyspark.sql import DataFrame

Node = dict[str, Any]


def collect_tree(table: DataFrame) -> list[Node]:
    """Roots with ``children``, in pre-order."""
    found: dict[tuple[str, ...], Node] = {}
    roots = []
    for row in table.orderBy("position").collect():
        node = row.asDict(recursive=True) | {"children": []}
        path = tuple(node["path"])
        found[path] = node
        if len(path) > 1 and path[:-1] in found:
            found[path[:-1]]["children"].append(node)
        else:
            roots.append(node)
    return roots


def _label(node: Node) -> str:
    ms = "" if node.get("duration_ms") is None else f" ({node['duration_ms']} ms)"
    errors = f" [{node['error_count']} errors]" if node.get("error_count") else ""
    name = f" {node['name']}" if node.get("name") and node["name"] != node["id"] else ""
    return f"{node['id']}{name}{ms}{errors}"


def tree(roots: list[Node], max_depth: int | None = None) -> str:
    """One line a node, drawn with branches; deeper nodes than ``max_depth`` are counted."""
    out: list[str] = []

    def walk(node: Node, lead: str, last: bool, depth: int) -> None:
        out.append(_label(node) if depth == 0 else f"{lead}{'└─ ' if last else '├─ '}{_label(node)}")
        inner = "" if depth == 0 else lead + ("   " if last else "│  ")
        kids = node["children"]
        if max_depth is not None and depth >= max_depth and kids:
            out.append(f"{inner}└─ … {len(kids)} more")
            return
        for i, kid in enumerate(kids):
            walk(kid, inner, i == len(kids) - 1, depth + 1)

    for root in roots:
        walk(root, "", True, 0)
    return "\n".join(out)


def _flat(roots: list[Node]) -> list[tuple[int, Node]]:
    out: list[tuple[int, Node]] = []
    stack = [(0, r) for r in reversed(roots)]
    while stack:
        depth, node = stack.pop()
        out.append((depth, node))
        stack += [(depth + 1, k) for k in reversed(node["children"])]
    return out


def waterfall(roots: list[Node], width: int = 60) -> str:
    """A bar for each timed node on one time axis."""
    timed = [(d, n) for d, n in _flat(roots) if n.get("start_time")]
    if not timed:
        return "(no times)"
    begin = min(n["start_time"] for _, n in timed)
    ms = lambda n: (n["start_time"] - begin).total_seconds() * 1000
    whole = max(max(ms(n) + (n.get("duration_ms") or 0) for _, n in timed), 1)
    out = []
    for depth, n in timed:
        at = int(ms(n) / whole * width)
        size = max(1, round((n.get("duration_ms") or 0) / whole * width))
        out.append(f"{'  ' * depth + n['id']:<28.28} |{' ' * at}{('!' if n.get('error_count') else '█') * min(size, width - at or 1):<{width - at}}| {n.get('duration_ms') or 0} ms")
    return "\n".join(out)


def flamegraph(roots: list[Node], width: int = 80) -> str:
    """A row for each depth, nodes as wide as their part of the total."""
    total = sum(r.get("duration_ms") or 0 for r in roots)
    if total <= 0:
        return "(no durations)"
    rows: dict[int, list[str]] = defaultdict(list)
    for depth, n in _flat(roots):
        size = max(1, int((n.get("duration_ms") or 0) / total * width))
        rows[depth].append(f"[{n['id'][: max(size - 2, 0)]:-<{max(size - 2, 0)}}]")
    return "\n".join("".join(rows[d])[: width * 2] for d in sorted(rows))


def collapsed_stacks(roots: list[Node]) -> list[str]:
    """``a;b;c self_ms`` lines for flame-graph tools."""
    out = []

    def walk(node: Node, stack: list[str]) -> None:
        here = [*stack, node["id"]]
        own = max((node.get("duration_ms") or 0) - sum(k.get("duration_ms") or 0 for k in node["children"]), 0)
        if own:
            out.append(f"{';'.join(here)} {own}")
        for kid in node["children"]:
            walk(kid, here)

    for root in roots:
        walk(root, [])
    return out


def summary(roots: list[Node]) -> str:
    nodes = [n for _, n in _flat(roots)]
    errors = [n for n in nodes if n.get("error_count")]
    slow = sorted((n for n in nodes if n.get("duration_ms")), key=lambda n: -n["duration_ms"])[:3]
    lines = [f"{len(nodes)} nodes, depth {max((d for d, _ in _flat(roots)), default=0)}, {len(errors)} with errors"]
    lines += [f"slow: {_label(n)}" for n in slow]
    return "\n".join(lines + [f"error: {_label(n)}" for n in errors[:5]])


def error_flow_summary(causes: list[dict[str, Any]], chains: list[dict[str, Any]]) -> str:
    if not causes:
        return "no errors"
    lines = [f"{len(causes)} root cause(s)"]
    lines += [f"- {c['id']} ({c['error_count']} errors, depth {c['depth']}, confidence {c['confidence']:.2f})" for c in causes[:5]]
    return "\n".join(lines + [f"  {' → '.join(c['chain'])}" for c in chains if len(c["chain"]) > 1][:5])
