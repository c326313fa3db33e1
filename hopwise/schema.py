"""Node types: what a label's vertices are called and how they are shown; kept as YAML, not enforced on data."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.errors import GraphError
from hopwise.graph import PropertyGraph


@dataclass
class NodeType:
    label: str
    icon: str = "info"
    key_field: str = "name"
    dataclass_name: str | None = None
    display_name: str | None = None
    display_order: int = 1000
    description: str | None = None


@dataclass
class GraphSchema:
    node_id_type_name: str = "str"
    base_uri: str | None = None
    node_type_configs: dict[str, NodeType] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> GraphSchema:
        import yaml

        found = yaml.safe_load(Path(path).read_text()) or {}
        known = NodeType.__dataclass_fields__
        types = {k: NodeType(**{f: v for f, v in c.items() if f in known}) for k, c in (found.get("node_type_configs") or {}).items()}
        return cls(found.get("node_id_type_name", "str"), found.get("base_uri"), types)

    def save(self, path: str) -> None:
        import yaml

        Path(path).write_text(yaml.safe_dump(asdict(self), sort_keys=False, allow_unicode=True))

    def of_labels(self, labels: list[str]) -> NodeType | None:
        """The type of a vertex: that of its first label."""
        return self.node_type_configs.get(labels[0]) if labels else None

    def ordered(self) -> list[NodeType]:
        return sorted(self.node_type_configs.values(), key=lambda t: (t.display_order, t.label))

    def node_table(self, graph: PropertyGraph, label: str) -> DataFrame:
        """The vertices of a type, with its key field first and without columns that none of them has."""
        if label not in self.node_type_configs:
            raise GraphError(f"no node type is named {label!r}")
        df = graph.get_nodes(label)
        key = self.node_type_configs[label].key_field
        filled = df.agg(*[F.count(c).alias(c) for c in df.columns]).first().asDict()
        rest = [c for c in df.columns if filled[c] and c not in (key, "_seq", "labels")]
        return df.select(*([key] if key in df.columns else []), *rest)
