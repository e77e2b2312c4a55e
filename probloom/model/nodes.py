"""Sum-product networks as immutable trees, and the same as three tables."""

from __future__ import annotations

import dataclasses
import json
import math
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from probloom.model.leaves import KINDS, Leaf, kind_of


@dataclass(frozen=True)
class Product:
    children: tuple[Node, ...]

    @property
    def scope(self) -> frozenset[int]:
        return frozenset().union(*[c.scope for c in self.children])


@dataclass(frozen=True)
class Sum:
    weights: tuple[float, ...]
    children: tuple[Node, ...]

    @property
    def scope(self) -> frozenset[int]:
        return frozenset().union(*[c.scope for c in self.children])

    @property
    def log_weights(self) -> tuple[float, ...]:
        return tuple(math.log(w) if w > 0 else -1e3 for w in self.weights)


Node = Sum | Product | Leaf


def children(node: Node) -> tuple[Node, ...]:
    return () if isinstance(node, Leaf) else node.children


def walk(root: Node) -> Iterator[Node]:
    """All nodes, top down, breadth first; a shared child comes once per parent."""
    queue = deque([root])
    while queue:
        node = queue.popleft()
        yield node
        queue.extend(children(node))


def leaves(root: Node) -> list[Leaf]:
    return [n for n in walk(root) if isinstance(n, Leaf)]


def by_type(root: Node) -> dict[str, list[Node]]:
    out: dict[str, list[Node]] = {}
    for n in walk(root):
        out.setdefault(type(n).__name__, []).append(n)
    return out


def size(root: Node) -> dict[str, int]:
    """Nodes, edges, sums, products, leaves and layers (the longest way down, so shared children don't matter)."""
    found = list(walk(root))
    depth = lambda n: 1 + max((depth(c) for c in children(n)), default=0)
    return {
        "nodes": len(found), "edges": sum(len(children(n)) for n in found), "sums": sum(isinstance(n, Sum) for n in found),
        "products": sum(isinstance(n, Product) for n in found), "leaves": sum(isinstance(n, Leaf) for n in found), "layers": depth(root),
    }


def validate(root: Node) -> None:
    """Completeness of sums, consistency of products, two children at least, weights that add up to 1."""
    for n in walk(root):
        if isinstance(n, Leaf):
            continue
        if len(n.children) < 2:
            raise ValueError(f"{type(n).__name__} has fewer than two children")
        scopes = [c.scope for c in n.children]
        if isinstance(n, Sum):
            if any(s != scopes[0] for s in scopes):
                raise ValueError("children of a sum differ in scope")
            if len(n.weights) != len(n.children) or abs(sum(n.weights) - 1) > 1e-6 or min(n.weights) < 0:
                raise ValueError("weights of a sum don't add up to 1")
        elif sum(map(len, scopes)) != len(n.scope):
            raise ValueError("children of a product share a feature")


def prune(node: Node) -> Node:
    """Merge sums below sums (weights multiply) and products below products; drop single-child nodes."""
    if isinstance(node, Leaf):
        return node
    kids = [prune(c) for c in node.children]
    if len(kids) == 1:
        return kids[0]
    if isinstance(node, Product):
        flat = [g for c in kids for g in (c.children if isinstance(c, Product) else (c,))]
        return Product(tuple(flat))
    pairs = [(w * v, g) for w, c in zip(node.weights, kids) for v, g in (zip(c.weights, c.children) if isinstance(c, Sum) else ((1.0, c),))]
    return Sum(tuple(w for w, _ in pairs), tuple(c for _, c in pairs))


def drop_features(node: Node, gone: frozenset[int]) -> Node | None:
    """The marginal without some features; None if nothing is left. A sum renormalises over the children that remain."""
    if isinstance(node, Leaf):
        return None if node.feature in gone else node
    kept = [drop_features(c, gone) for c in node.children]
    if isinstance(node, Product):
        some = [c for c in kept if c is not None]
        return None if not some else some[0] if len(some) == 1 else Product(tuple(some))
    pairs = [(w, c) for w, c in zip(node.weights, kept) if c is not None]
    if not pairs:
        return None
    total = sum(w for w, _ in pairs)
    return pairs[0][1] if len(pairs) == 1 else Sum(tuple(w / total for w, _ in pairs), tuple(c for _, c in pairs))


def marginal(root: Node, keep: frozenset[int] | set[int]) -> Node:
    """The model over ``keep`` alone, pruned."""
    out = drop_features(root, root.scope - frozenset(keep))
    if out is None:
        raise ValueError("no feature of the model is kept")
    return prune(out)


def replaced(node: Node, weights: Callable[[Sum], tuple[float, ...]]) -> Node:
    """The same structure with other sum weights."""
    if isinstance(node, Leaf):
        return node
    kids = tuple(replaced(c, weights) for c in node.children)
    return Product(kids) if isinstance(node, Product) else Sum(weights(node), kids)


# --- text forms ---------------------------------------------------------------


def sql(node: Node, columns: list[str]) -> str:
    """Log-likelihood as ANSI SQL; NULL values are unobserved."""
    if isinstance(node, Leaf):
        x = columns[node.feature]
        return f"CASE WHEN {x} IS NULL THEN 0 ELSE {node.sql(x)} END"
    parts = [f"({sql(c, columns)})" for c in node.children]
    if isinstance(node, Product):
        return " + ".join(parts)
    terms = [f"({p} + ({w!r}::DOUBLE))" for p, w in zip(parts, node.log_weights)]
    listed = "[" + ", ".join(terms) + "]"
    return f"(list_max({listed}) + ln(list_sum(list_transform({listed}, lambda v: exp(v - list_max({listed}))))))"


def formula(node: Node, names: list[str], evidence: dict[int, float] | None = None) -> str:
    """The density as an equation; leaves with evidence are folded to numbers."""
    import numpy as np

    if isinstance(node, Leaf):
        if evidence and node.feature in evidence:
            return f"{math.exp(float(node.numpy(np.array([evidence[node.feature]]))[0])):.10g}"
        fields = ",".join(f"{v:g}" if isinstance(v, float) else str(v) for k, v in dataclasses.asdict(node).items() if k != "feature")
        return f"{kind_of(node)}({names[node.feature]};{fields})"
    if isinstance(node, Product):
        return "(" + " * ".join(formula(c, names, evidence) for c in node.children) + ")"
    return "(" + " + ".join(f"{w:g}*{formula(c, names, evidence)}" for w, c in zip(node.weights, node.children)) + ")"


def dot(root: Node, names: list[str]) -> str:
    """Graph in DOT language, weights rounded to two places."""
    nodes, edges, _ = rows(root)
    label = {n: k if f is None else f"{k} {names[f]}" for n, k, f, _ in nodes}
    out = [f'  n{n} [label="{label[n]}"];' for n in label] + [f'  n{p} -> n{c}' + (f' [label="{w:.2f}"]' if w is not None else "") + ";" for p, c, _, w in edges]
    return "digraph model {\n" + "\n".join(out) + "\n}\n"


# --- tables -------------------------------------------------------------------

NODES, EDGES, LEAVES = "node long, kind string, feature int, is_root boolean", "parent long, child long, place int, weight double", "node long, feature int, kind string, params string"


def rows(root: Node) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Rows of the three tables; ids count breadth first from 0."""
    nodes, edges, params = [], [], []
    queue, last = deque([(root, 0)]), 0
    while queue:
        node, at = queue.popleft()
        leaf = isinstance(node, Leaf)
        nodes.append((at, kind_of(node) if leaf else type(node).__name__.lower(), node.feature if leaf else None, at == 0))
        if leaf:
            params.append((at, node.feature, kind_of(node), json.dumps({k: v for k, v in dataclasses.asdict(node).items() if k != "feature"})))
        for i, c in enumerate(children(node)):
            last += 1
            edges.append((at, last, i, node.weights[i] if isinstance(node, Sum) else None))
            queue.append((c, last))
    return nodes, edges, params


def to_tables(spark: SparkSession, root: Node) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, leaves): the form in which models are kept, as Parquet or JSON."""
    n, e, p = rows(root)
    return spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES), spark.createDataFrame(p, LEAVES)


def from_tables(nodes: DataFrame, edges: DataFrame, params: DataFrame) -> Node:
    """The model of three tables (a model's size, not the data's)."""
    kind = {r["node"]: r["kind"] for r in nodes.collect()}
    below: dict[int, list] = {}
    for r in edges.orderBy("parent", "place").collect():
        below.setdefault(r["parent"], []).append((r["child"], r["weight"]))
    leaf = {r["node"]: KINDS[r["kind"]](r["feature"], **{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(r["params"]).items()}) for r in params.collect()}

    def build(at: int) -> Node:
        if at in leaf:
            return leaf[at]
        kids = tuple(build(c) for c, _ in below[at])
        return Product(kids) if kind[at] == "product" else Sum(tuple(w for _, w in below[at]), kids)

    return build(next(r["node"] for r in nodes.where("is_root").collect()))


def save(spark: SparkSession, root: Node, path: str) -> None:
    for name, df in zip(("nodes", "edges", "leaves"), to_tables(spark, root)):
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Node:
    return from_tables(*[spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "leaves")])
