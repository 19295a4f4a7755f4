"""The edge classifier and the merge scorer: numpy passes over one graph at a time, in buckets of graphs."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import by_graph, dealt, matrix
from .gradient import Traced, binned

#: Columns of a node, of an edge and of a contour, in the order that weights expect.
NODE = ["x", "y", "tan_x", "tan_y", "off_x", "off_y", "cx", "cy", "w", "h", "arc", "cos_phase", "sin_phase"]
EDGE = ["dx", "dy", "dist", "same"]
CONTOUR = ["cx", "cy", "w", "h", "min_x", "min_y", "arc", "area"]
RELATIONS, SCALARS = 11, 7
MARGINS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8]


@dataclass(frozen=True)
class Options:
    """What a model consists of. Options that a weight dump doesn't name are off; relations need contours."""

    hidden: int = 16
    layers: int = 2
    heads: int = 2
    node_dim: int = len(NODE)
    edge_dim: int = len(EDGE)
    contour_dim: int = len(CONTOUR)
    context: bool = True
    contours: bool = True
    relations: bool = True
    group: bool = True

    def __post_init__(self):
        if self.hidden % self.heads:
            raise ValueError(f"{self.heads} heads don't divide {self.hidden}")

    @property
    def related(self) -> bool:
        return self.contours and self.relations

    @staticmethod
    def of(given: dict) -> Options:
        numbers = {k: int(given[k]) for k in ("hidden", "layers", "heads", "node_dim", "edge_dim", "contour_dim") if k in given}
        return Options(**numbers, **{k: bool(given.get(k, False)) for k in ("context", "contours", "relations", "group")})

    def shapes(self) -> dict[str, tuple[int, ...]]:
        """Names and shapes of all tensors; the names are fixed values of the dump's format."""
        d, out = self.hidden, {}

        def linear(name: str, rows: int, columns: int):
            out[f"{name}.weight"], out[f"{name}.bias"] = (rows, columns), (rows,)

        def norm(name: str):
            out[f"{name}.weight"], out[f"{name}.bias"] = (d,), (d,)

        linear("encoder.0", d, self.node_dim)
        linear("encoder.2", d, d)
        norm("encoder.3")
        for i in range(self.layers):
            for name, columns in (("lin_src", d), ("lin_dst", d), ("lin_edge", self.edge_dim), ("out", d)):
                linear(f"convs.{i}.{name}", d, columns)
            out[f"convs.{i}.att"] = (1, self.heads, d // self.heads)
            norm(f"convs.{i}.norm")
            if self.contours:
                for name, columns in (("embed", self.contour_dim), ("query", d), ("key", d), ("value", d), ("proj", d), ("out", d)):
                    linear(f"contour_layers.{i}.{name}", d, columns)
                if self.related:
                    linear(f"contour_layers.{i}.rel_bias", self.heads, RELATIONS)
                norm(f"contour_layers.{i}.norm_contour")
                norm(f"contour_layers.{i}.norm")
        if self.context:
            linear("context.0", d, 2 * d)
        inputs = d * (4 if self.context else 3) + self.edge_dim + (RELATIONS if self.related else 0)
        for name, rows, columns in (("0", d, inputs), ("3", d // 2, d), ("5", 1, d // 2)):
            linear(f"classifier.{name}", rows, columns)
        if self.group:
            for name, rows, columns in (("0", d, 3 * (2 * d + SCALARS) + d + 1), ("3", d // 2, d), ("5", 1, d // 2)):
                linear(f"group_head.net.{name}", rows, columns)
        return out


def seeded(options: Options = Options(), seed: int = 0) -> dict[str, np.ndarray]:
    """Weights of a model that learned nothing."""
    rng = np.random.default_rng(seed)
    return {k: rng.standard_normal(s) / math.sqrt(s[-1]) if len(s) > 1 else rng.standard_normal(s) * 0.1 + (1.0 if ".norm" in k and k.endswith("weight") else 0.0) for k, s in options.shapes().items()}


def checked(options: Options, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The tensors that the options need, in their shapes; ValueError names the first that is missing or of another size."""
    out = {}
    for name, shape in options.shapes().items():
        if name not in weights or weights[name].size != math.prod(shape):
            raise ValueError(f"tensor {name} is missing or isn't {shape}")
        out[name] = np.asarray(weights[name], dtype=np.float64).reshape(shape)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def relations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 11 relations of contours a with contours b, by their rows of CONTOUR; leading dimensions are broadcast."""
    eps = 1e-6
    at = {n: (a[..., i], b[..., i]) for i, n in enumerate(CONTOUR)}
    low = [at["min_x"], at["min_y"]]
    size = [at["w"], at["h"]]
    high = [(m[0] + s[0], m[1] + s[1]) for m, s in zip(low, size, strict=True)]
    over = [np.minimum(*h) - np.maximum(*m) for h, m in zip(high, low, strict=True)]
    share = [np.clip(o / np.maximum(np.minimum(*s), eps), -4, 1) for o, s in zip(over, size, strict=True)]
    depth = lambda i, o: np.minimum(np.minimum(low[0][i] - low[0][o], low[1][i] - low[1][o]), np.minimum(high[0][o] - high[0][i], high[1][o] - high[1][i]))
    dx, dy = at["cx"][1] - at["cx"][0], at["cy"][1] - at["cy"][0]
    arc, turn = np.log((at["arc"][0] + eps) / (at["arc"][1] + eps)), np.sign(at["area"][0]) * np.sign(at["area"][1])
    return np.stack([dx, dy, np.hypot(dx, dy), *over, *share, depth(0, 1), depth(1, 0), arc, turn], axis=-1)


def segment_sum(values, bins: np.ndarray, n: int):
    """Rows of values, plain or traced, summed by bin; empty bins are 0."""
    return values.binned(bins, n) if isinstance(values, Traced) else binned(values, bins, n)


def segment_mean(values, bins: np.ndarray, n: int):
    return segment_sum(values, bins, n) / np.maximum(np.bincount(bins, minlength=n), 1)[:, None]


@dataclass
class Graph:
    """One graph as arrays: nodes by NODE, ends and features of edges, the contour of each node, contours by CONTOUR."""

    nodes: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    edges: np.ndarray
    contour: np.ndarray
    contours: np.ndarray


class Model:
    """The forward pass, of plain weights or traced ones. kept is what training drops some of; else it changes nothing."""

    def __init__(self, options: Options, weights: dict[str, np.ndarray], kept=lambda x: x):
        self.options, self.w, self.kept = options, checked(options, weights), kept

    def linear(self, name: str, x: np.ndarray) -> np.ndarray:
        return x @ self.w[f"{name}.weight"].T + self.w[f"{name}.bias"]

    def norm(self, name: str, x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
        centred = x - x.mean(axis=-1, keepdims=True)
        return centred / np.sqrt((centred * centred).mean(axis=-1, keepdims=True) + eps) * self.w[f"{name}.weight"] + self.w[f"{name}.bias"]

    def perceptron(self, name: str, x: np.ndarray) -> np.ndarray:
        x = self.kept(np.maximum(self.linear(f"{name}.0", x), 0))
        return self.linear(f"{name}.5", np.maximum(self.linear(f"{name}.3", x), 0))[..., 0]

    def encoded(self, x: np.ndarray) -> np.ndarray:
        return self.norm("encoder.3", self.linear("encoder.2", np.maximum(self.linear("encoder.0", x), 0)))

    def attended(self, i: int, h: np.ndarray, g: Graph) -> np.ndarray:
        """Attention over the edges that reach a node. The softmax takes off the maximum of the whole graph."""
        o, name = self.options, f"convs.{i}"
        source = self.linear(f"{name}.lin_src", h)[g.src].reshape(len(g.src), o.heads, -1)
        x = source + (self.linear(f"{name}.lin_dst", h)[g.dst] + self.linear(f"{name}.lin_edge", g.edges)).reshape(source.shape)
        logit = (np.where(x >= 0, x, 0.2 * x) * self.w[f"{name}.att"]).sum(axis=-1)
        e = np.exp(logit - (logit.max() if logit.size else 0.0))
        total = segment_sum(e, g.dst, len(h)) + 1e-9
        message = segment_sum(source * self.kept(e)[..., None], g.dst, len(h)) / total[..., None]
        return self.norm(f"{name}.norm", h + self.linear(f"{name}.out", message.reshape(len(h), -1)))

    def contoured(self, i: int, h: np.ndarray, g: Graph, related: np.ndarray | None) -> np.ndarray:
        """Attention between all contours of a graph, given back to their nodes."""
        o, name, n = self.options, f"contour_layers.{i}", len(g.contours)
        z = self.norm(f"{name}.norm_contour", segment_mean(h, g.contour, n) + self.linear(f"{name}.embed", g.contours))
        q, k, v = (self.linear(f"{name}.{x}", z).reshape(n, o.heads, -1).transpose(1, 0, 2) for x in ("query", "key", "value"))
        logit = q @ k.transpose(0, 2, 1) / math.sqrt(o.hidden // o.heads)
        if related is not None:
            logit = logit + self.linear(f"{name}.rel_bias", related).transpose(2, 0, 1)
        e = np.exp(logit - logit.max(axis=-1, keepdims=True)) if n else logit
        mixed = (self.kept(e / e.sum(axis=-1, keepdims=True)) @ v).transpose(1, 0, 2).reshape(n, -1)
        z = z + self.linear(f"{name}.proj", mixed)
        return self.norm(f"{name}.norm", h + self.linear(f"{name}.out", z)[g.contour])

    def trunk(self, g: Graph) -> tuple[np.ndarray, np.ndarray]:
        """States of the nodes and the summary of the graph, of no width without context."""
        o, h = self.options, self.encoded(g.nodes)
        related = relations(g.contours[:, None], g.contours[None]) if o.related else None
        for i in range(o.layers):
            h = self.attended(i, h, g)
            if o.contours:
                h = self.contoured(i, h, g, related)
        summary = np.maximum(self.linear("context.0", np.concatenate([h.mean(axis=0), h.max(axis=0)])), 0) if o.context else np.zeros(0)
        return h, summary

    def logits(self, h: np.ndarray, summary: np.ndarray, g: Graph, some: np.ndarray) -> np.ndarray:
        """Of the edges some (places): whether their ends are of one character."""
        src, dst = g.src[some], g.dst[some]
        parts = [h[src], h[dst], np.abs(h[src] - h[dst]), g.edges[some]]
        if self.options.related:
            parts.append(relations(g.contours[g.contour[src]], g.contours[g.contour[dst]]))
        parts.append(np.broadcast_to(summary, (len(some), len(summary))))
        return self.perceptron("classifier", np.concatenate(parts, axis=1))

    def states(self, h: np.ndarray, g: Graph) -> np.ndarray:
        return segment_mean(h, g.contour, len(g.contours))

    def merge_logit(self, left, right, union, summary, link: float):
        """Whether two described groups belong together, of which union is what they make, and link what links them most."""
        line = summary if len(summary) else np.zeros(self.options.hidden)
        return self.perceptron("group_head.net", np.concatenate([left, right, union, line, [link]]))


@dataclass(frozen=True)
class Group:
    """What a set of contours adds up to; the union of two follows from theirs."""

    n: int
    total: np.ndarray
    top: np.ndarray
    low: np.ndarray
    high: np.ndarray
    arc: float
    area: float

    @staticmethod
    def of(state: np.ndarray, row: np.ndarray) -> Group:
        at = dict(zip(CONTOUR, row.tolist(), strict=True))
        low = np.array([at["min_x"], at["min_y"]])
        return Group(1, state, state, low, low + [at["w"], at["h"]], at["arc"], abs(at["area"]))

    def __add__(self, o: Group) -> Group:
        return Group(self.n + o.n, self.total + o.total, np.maximum(self.top, o.top), np.minimum(self.low, o.low), np.maximum(self.high, o.high), self.arc + o.arc, self.area + o.area)

    def described(self) -> np.ndarray:
        """Mean and largest state, and the shape: width, height, contours, arc, area, aspect, compactness."""
        w, h = np.maximum(self.high - self.low, 0)
        return np.concatenate([self.total / max(self.n, 1), self.top, [w, h, self.n, self.arc, self.area, w / max(h, 1e-6), self.arc / max(w + h, 1e-6)]])


def agglomerated(n: int, pairs: list[tuple[int, int, float]], merges, floor: float = 0.1) -> list[int]:
    """The group of each of n contours, by its smallest, after trying pairs from floor up in order of falling probability, then
    contours. merges(left, right, link) decides on two groups as they are, each a sorted tuple; link is the highest
    probability of any pair between them."""
    of = [(c,) for c in range(n)]
    best: dict[int, dict[int, float]] = {c: {} for c in range(n)}
    for a, b, p in pairs:
        best[a][b] = best[b][a] = max(p, best[a].get(b, 0.0))
    for a, b, _ in sorted((x for x in pairs if x[2] >= floor and x[0] != x[1]), key=lambda x: (-x[2], x[0], x[1])):
        left, right = of[a], of[b]
        if left == right:
            continue
        if left > right:
            left, right = right, left
        i, j = left[0], right[0]
        if not merges(left, right, best[i].get(j, 0.0)):
            continue
        both = tuple(sorted(left + right))
        for c in both:
            of[c] = both
        for k, p in best.pop(j).items():  # what the second group is linked to, the first is now
            best[k].pop(j, None)
            if k != i:
                best[i][k] = best[k][i] = max(p, best[i].get(k, 0.0))
    return [x[0] for x in of]


def _graphs(nodes: pa.Table, edges: pa.Table):
    """(g, Graph, places of the edges, contour ids) of each graph of a bucket."""
    if not nodes.num_rows:
        return
    every, edge = slice(None), matrix(edges, EDGE, slice(None)) if edges.num_rows else np.empty((0, len(EDGE)))
    x, rows = matrix(nodes, NODE, every), matrix(nodes, [f"_{f}" for f in CONTOUR], every)
    c, n, src, dst = nodes.column("c").to_numpy(), nodes.column("n").to_numpy(), edges.column("src").to_numpy(), edges.column("dst").to_numpy()
    for g, a, u in by_graph((nodes, ["n"]), (edges, ["e"])):
        ids, first, contour = np.unique(c[a], return_index=True, return_inverse=True)
        yield g, Graph(x[a], np.searchsorted(n[a], src[u]), np.searchsorted(n[a], dst[u]), edge[u], contour, rows[a][first]), u, ids


def _bucketed(nodes: DataFrame, edges: DataFrame, contours: DataFrame, run, schema: str, also: tuple[str, ...] = ()) -> DataFrame:
    rows = contours.select("g", "c", *[F.col(f).alias(f"_{f}") for f in CONTOUR])
    own = nodes.select("g", "n", "c", *NODE).join(rows, ["g", "c"])
    links = edges.select("g", "e", "src", "dst", *[F.col(f).cast("double").alias(f) for f in EDGE], *also)
    return dealt(own, links, run, schema, nodes.count())


def model_scores(nodes: DataFrame, edges: DataFrame, contours: DataFrame, options: Options = Options(), weights: dict[str, np.ndarray] | None = None, every: bool = False) -> DataFrame:
    """(g, e, prob) of the edges between contours, or of every edge; graphs without any aren't scored.

    nodes has g, n, c and NODE, edges g, e, src, dst and EDGE, contours g, c and CONTOUR. weights are those of a dump
    (readers.read_weights); without, of a model that learned nothing.
    """
    shared = nodes.sparkSession.sparkContext.broadcast((options, weights or seeded(options)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model = Model(*shared.value)
        gs, es, ps = [], [np.empty(0, np.int64)], [np.empty(0)]
        ids = right.column("e").to_numpy()
        for g, graph, rows, _ in _graphs(left, right):
            some = np.flatnonzero(every | (graph.edges[:, 3] == 0))
            if len(some):
                h, summary = model.trunk(graph)
                gs += [g] * len(some)
                es.append(ids[rows[some]])
                ps.append(sigmoid(model.logits(h, summary, graph, some)))
        return pa.table({"g": pa.array(gs, pa.int64()), "e": pa.array(np.concatenate(es), pa.int64()), "prob": pa.array(np.concatenate(ps), pa.float64())})

    return _bucketed(nodes, edges, contours, run, "g bigint, e bigint, prob double")


def merged_groups(nodes: DataFrame, edges: DataFrame, contours: DataFrame, margins: list[float] = MARGINS, options: Options = Options(), weights: dict[str, np.ndarray] | None = None, floor: float = 0.1) -> DataFrame:
    """(g, threshold, c, grp): contours grouped by the merge scorer at each margin, of one forward pass of each graph.

    Arguments as for model_scores; options must have group. The order of tries comes from the classifier's pair maxima.
    """
    if not options.group:
        raise ValueError("the model has no merge scorer")
    shared = nodes.sparkSession.sparkContext.broadcast((options, weights or seeded(options)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model, out = Model(*shared.value), [[], [], [], []]
        for g, graph, _, ids in _graphs(left, right):
            h, summary = model.trunk(graph)
            some = np.flatnonzero(graph.edges[:, 3] == 0)
            ends = np.sort(np.stack([graph.contour[graph.src[some]], graph.contour[graph.dst[some]]]), axis=0)
            best: dict[tuple[int, int], float] = {}
            for a, b, p in zip(*ends.tolist(), sigmoid(model.logits(h, summary, graph, some)).tolist() if len(some) else [], strict=True):
                best[a, b] = max(p, best.get((a, b), 0.0))
            states, memo = model.states(h, graph), {}

            def group(members: tuple[int, ...]) -> Group:
                if members not in memo:  # noqa: B023
                    parts = [Group.of(states[c], graph.contours[c]) for c in members]  # noqa: B023
                    memo[members] = sum(parts[1:], parts[0])  # noqa: B023
                return memo[members]  # noqa: B023

            for margin in margins:
                def merges(a, b, link, margin=margin):
                    one, two = group(a), group(b)  # noqa: B023
                    return sigmoid(model.merge_logit(one.described(), two.described(), (one + two).described(), summary, link)) >= margin  # noqa: B023

                found = agglomerated(len(ids), [(a, b, p) for (a, b), p in best.items()], merges, floor)
                for column, values in zip(out, ([g] * len(ids), [margin] * len(ids), ids.tolist(), ids[found].tolist()), strict=True):
                    column += values
        return pa.table({n: pa.array(v, t) for n, v, t in zip(("g", "threshold", "c", "grp"), out, (pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)})

    return _bucketed(nodes, edges, contours, run, "g bigint, threshold double, c bigint, grp bigint")
