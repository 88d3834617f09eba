"""Settings of a project folder: which source files there are, and where results go. A TOML file; nothing is global."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

_SOURCES = ("reactome", "ontology", "proteins", "hint", "biogrid", "phosphosite", "trrust", "complexes")


@dataclass(frozen=True)
class Config:
    """home: where everything is; sources: name to path; organism and tax_ids: of the proteins."""

    home: Path
    sources: dict[str, str] = field(default_factory=dict)
    organism: str = "Human"
    tax_ids: tuple[str, ...] = ("9606",)
    depth: int = 24
    namespaces: tuple[str, ...] = ()

    def folder(self, *parts: str) -> str:
        """graph, models, nulls, mapped and results lie below home."""
        return str(self.home.joinpath(*parts))

    def outputs(self, experiment: str) -> dict[str, str]:
        """The files of an experiment by what they hold."""
        return {name: self.folder("results", experiment, file) for name, file in {"nodes": "nodes", "clusters": "clusters", "graph": "flow.gdf", "annotome_nodes": "terms", "annotome_graph": "terms.gdf"}.items()}


def located(home: Path, where: str) -> str:
    """A source's path: a file, a folder, or the first of the files that a pattern with ``*`` names; ``$HOME_FOLDER`` stands for home."""
    path = where.replace("$HOME_FOLDER", str(home))
    path = path if Path(path).is_absolute() or "://" in path else str(home / path)
    if "*" not in path:
        return path
    found = sorted(Path(path).parent.glob(Path(path).name))
    if not found:
        raise FileNotFoundError(path)
    return str(found[0])


def read(path: str | Path) -> Config:
    path = Path(path)
    with path.open("rb") as f:
        raw = tomllib.load(f)
    home = Path(raw.get("home", path.parent)).resolve()
    if unknown := set(raw.get("sources", {})) - set(_SOURCES):
        raise ValueError(f"unknown sources {sorted(unknown)}; known are {list(_SOURCES)}")
    return Config(home, {k: located(home, v) for k, v in raw.get("sources", {}).items()}, raw.get("organism", "Human"), tuple(map(str, raw.get("tax_ids", ["9606"]))), int(raw.get("depth", 24)), tuple(raw.get("namespaces", [])))
