"""Metadata beside a table: origin, lineage, tokens and templates, with the checks of each stage."""

from __future__ import annotations

import hashlib
import typing
from dataclasses import dataclass, field, fields, is_dataclass, replace
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import SparkSession

from tessera.sources import storage

KIND, VERSION, SUFFIX = "tessera_dataset", 1, ".meta.yaml"
#: What a table of each stage must say, by path (fixed rules of the format; any stage needs its extraction).
NEEDED = {
    "av_sft": ("tokens.injection_char", "prompt_templates.actor"),
    "ar_sft": ("tokens.injection_char", "tokens.critic_suffix_ids", "prompt_templates.actor", "prompt_templates.critic"),
    "rl": ("tokens.injection_char", "prompt_templates.actor"),
}


# The names of all fields below are fixed values of the file format.


@dataclass(frozen=True)
class Slice:
    """Rows of a corpus from ``start`` on."""

    start: int
    length: int

    @property
    def end(self) -> int:
        return self.start + self.length


@dataclass(frozen=True)
class Extraction:
    base_model: str
    d_model: int
    layer_index: int
    norm: str
    corpus: str
    corpus_slice: Slice
    positions_per_doc: int


@dataclass(frozen=True)
class Tokens:
    injection_char: str
    injection_token_id: int
    injection_left_neighbor_id: int | None = None
    injection_right_neighbor_id: int | None = None
    critic_suffix_ids: list[int] | None = None


@dataclass(frozen=True)
class DatasetMeta:
    dataset_id: str
    stage: str
    row_count: int
    extraction: Extraction
    tokens: Tokens | None = None
    prompt_templates: dict[str, str] = field(default_factory=dict)
    api_summaries: dict[str, Any] | None = None
    parent_datasets: list[str] = field(default_factory=list)
    created_by: str = ""
    created_at: str = ""
    git_commit: str = ""
    kind: str = KIND
    schema_version: int = VERSION


def replaced(meta: DatasetMeta, **changes) -> DatasetMeta:
    """A copy for a new table; its time is set when it is written."""
    return replace(meta, created_at="", git_commit="", **changes)


def base_id(origin: Extraction) -> str:
    """The id of a base table: its model's last name, its layer and a digest of its origin."""
    where = {"start": origin.corpus_slice.start, "length": origin.corpus_slice.length}
    digest = hashlib.sha256("|".join(str(x) for x in (origin.base_model, origin.layer_index, origin.corpus, where)).encode())
    return f"base_{origin.base_model.rpartition('/')[2]}_L{origin.layer_index}_{digest.hexdigest()[:8]}"


def derived_id(parent: str, stage: str, name: str = "", seed: int = 0) -> str:
    """Ids of derived tables: split, explained, built, shuffled."""
    if stage == "split":
        return f"{parent}__{name}_raw"
    if stage == "explain":
        return f"{parent}__explained"
    if stage == "build":
        return f"{name}_{parent.removeprefix('base_')}"
    return f"{parent}__shuf{seed}"


def _plain(x: Any) -> Any:
    """Nested records as mappings; fields without a value are left out."""
    if is_dataclass(x):
        x = {f.name: getattr(x, f.name) for f in fields(x)}
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items() if v is not None}
    return x


def _typed(kind: Any, x: Any) -> Any:
    """A mapping as the record that it stands for; names that the record doesn't know are passed over."""
    options = [k for k in (kind, *typing.get_args(kind)) if is_dataclass(k)]
    if not options or x is None:
        return x
    record, hints = options[0], typing.get_type_hints(options[0])
    try:
        return record(**{name: _typed(hints[name], x[name]) for name in hints if name in x})
    except TypeError as e:
        raise ValueError(f"{record.__name__.lower()} is incomplete: {e}") from e


def _at(x: Any, path: str) -> Any:
    for name in path.split("."):
        x = x.get(name) if isinstance(x, dict) else getattr(x, name, None)
    return x


def checked(meta: DatasetMeta) -> DatasetMeta:
    """meta, if it says all that its stage needs."""
    if lacking := [path for path in NEEDED.get(meta.stage, ()) if _at(meta, path) in (None, "", [])]:
        raise ValueError(f"a table of {meta.stage} must say {', '.join(lacking)}")
    return meta


def commit(checkout: Path = Path(__file__).parents[2]) -> str:
    """The commit of the checkout that holds this library, as its files say it; nothing without one."""
    store = checkout / ".git"
    try:
        said = (store / "HEAD").read_text().strip()
        if not said.startswith("ref: "):
            return said
        name = said.removeprefix("ref: ")
        if (store / name).exists():
            return (store / name).read_text().strip()
        packed = [line.split(" ", 1) for line in (store / "packed-refs").read_text().splitlines() if not line.startswith(("#", "^"))]
        return {ref: found for found, ref in packed}.get(name, "")
    except OSError:
        return ""


def unbuilt(meta: DatasetMeta) -> DatasetMeta:
    """meta, if training tables may be built from it: rows as they were extracted (or explained), with vectors as the model gave them."""
    if meta.stage != "base":
        raise ValueError(f"{meta.dataset_id} is a table of {meta.stage}; what is built already isn't built again")
    if meta.extraction.norm != "none":
        raise ValueError(f"the vectors of {meta.dataset_id} are scaled ({meta.extraction.norm}); only training scales them")
    return meta


def dumps(meta: DatasetMeta) -> str:
    stamped = replace(checked(meta), created_at=meta.created_at or datetime.now(timezone.utc).isoformat(), git_commit=meta.git_commit or commit())
    return yaml.safe_dump(_plain(stamped), sort_keys=False)


def loads(said: str, kind: str = KIND) -> DatasetMeta:
    """kind: what the writer calls its tables, so that other writers' sidecars can be read."""
    doc = yaml.safe_load(said)
    found = (doc.get("kind"), doc.get("schema_version"))
    if found != (kind, VERSION):
        raise ValueError(f"kind and version are {found}, not {(kind, VERSION)}")
    return _typed(DatasetMeta, doc)


def sidecar_path(path: str, suffix: str = SUFFIX) -> str:
    """Beside the table; a slice suffix of the path names rows, not files."""
    return storage.without_slice(path) + suffix


def write(spark: SparkSession, path: str, meta: DatasetMeta) -> None:
    """After the data are committed, never before."""
    storage.write_text(spark, sidecar_path(path), dumps(meta))


def read(spark: SparkSession, path: str, kind: str = KIND, suffix: str = SUFFIX) -> DatasetMeta:
    return loads(storage.read_text(spark, sidecar_path(path, suffix)), kind)


def verify(meta: DatasetMeta, token_ids, prompt_ids=None, scales: dict | None = None) -> dict[str, Any]:
    """Runtime settings of a training table, if the live tokenizer agrees with the sidecar.

    token_ids: text to ids. prompt_ids: text to the ids of a whole prompt, as the model gets it, for the marker's neighbours;
    those of the sidecar must be found there. scales: mse_scale and injection_scale, where a run sets them.
    """
    t, origin = meta.tokens, meta.extraction
    if t is None or list(token_ids(t.injection_char)) != [t.injection_token_id]:
        raise ValueError("the tokenizer doesn't agree with the sidecar's marker")
    sides = (t.injection_left_neighbor_id, t.injection_right_neighbor_id)
    if prompt_ids is not None:
        from tessera.functions.tokens import neighbours

        live = neighbours(list(prompt_ids(meta.prompt_templates["actor"].replace("<INJECT>", t.injection_char))), t.injection_token_id)
        if sides != (None, None) and live != sides:
            raise ValueError(f"the marker's neighbours are {live}, the sidecar says {sides}")
        sides = live
    return {
        "d_model": origin.d_model,
        "mse_scale": origin.d_model**0.5,
        "injection_scale": None,
        **(scales or {}),
        "marker": (t.injection_char, t.injection_token_id),
        "neighbours": sides,
        "actor": meta.prompt_templates.get("actor", meta.prompt_templates.get("av")),
        "critic": meta.prompt_templates.get("critic", meta.prompt_templates.get("ar")),
    }
