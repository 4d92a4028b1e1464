"""Options of the engine: defaults, plain ``name: value`` text, and the options table."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Options:
    """A graph carries its options, ``PropertyGraph(v, e, options)``, and hands them on to graphs made of it."""

    #: A vertex with at least this many neighbours counts as giant.
    giant_vertex_boundary: int = 128
    #: Bytes of a storage block; a Parquet page of a saved graph has 256 of them.
    block_size: int = 4096
    #: Edges up to which an algorithm finishes in one task, 16 bytes an edge; larger graphs run in distributed rounds. 0: always those.
    local_edges: int = 4_000_000
    #: Vertices over which subsets are tried one by one; 2 to this power masks are tested at most. More raise ValueError.
    max_vset_vertices: int = 24
    #: Vertices up to which all masks are tested at once whatever the sentence: one stage instead of one per set size.
    masked_vertices: int = 16
    #: Vertices whose compatible pairs may be listed for a filter that is stored by its false tuples. More raise ValueError.
    max_pairs_of: int = 5000
    #: Rows that binding an unrestricted variable to all vertices may make before a query is refused.
    max_bindings: int = 20_000_000

    @classmethod
    def parse(cls, text: str) -> Options:
        """A flat YAML mapping of names to whole numbers: ``name: value`` lines, also within ``{}`` and ``---``, quoted or with ``_``.

        Blank lines and comments after ``#`` are skipped; unknown names and other values raise.
        """
        known, got = {f.name for f in fields(cls)}, {}
        flat = "\n".join(line.split("#")[0] for line in text.splitlines()).replace("{", "\n").replace("}", "\n").replace(",", "\n")
        for line in flat.splitlines():
            line = line.strip()
            if line in ("", "---", "..."):
                continue
            name, sep, value = (x.strip().strip("'\"") for x in line.partition(":"))
            if not sep or name not in known:
                raise ValueError(f"{line!r} is no option")
            got[name] = int(value)
        return cls(**got)

    @classmethod
    def load(cls, path: str) -> Options:
        with open(path) as f:
            return cls.parse(f.read())

    def dump(self) -> str:
        return "".join(f"{k}: {v}\n" for k, v in asdict(self).items())

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            f.write(self.dump())

    def with_table(self, rows: DataFrame) -> Options:
        """Overridden by a table ``(option_name, option_value)`` with one row per option."""
        known = {f.name for f in fields(self)}
        return replace(self, **{r["option_name"]: int(r["option_value"]) for r in rows.where(rows.option_name.isin(sorted(known))).collect()})
