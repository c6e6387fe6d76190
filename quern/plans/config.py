"""Engine settings: defaults, then a file's sections, then what the caller gives."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

#: Mean of an hour's values above which the generated alerts fire.
HIGH_MEAN = 20


@dataclass(frozen=True)
class Settings:
    """The defaults of chunking, embedding and the refusal gate."""

    threshold: int = 700
    dedupe_repealed: bool = True
    embedding_model: str = "external"
    batch_size: int = 32
    min_score: float | None = 0.47
    primary_doc: str = "primary"
    index_path: str | None = None


def _typed(name: str, value):
    """A file's text as the type of the setting's default."""
    default = getattr(Settings(), name)
    if not isinstance(value, str) or isinstance(default, str) or default is None:
        return value
    return value.lower() == "true" if isinstance(default, bool) else type(default)(value)


def settings(file_values: dict | None = None, **given) -> Settings:
    """given beats file_values (flat or by section) beats the defaults; None is not given."""
    flat: dict = {}
    for k, v in (file_values or {}).items():
        flat |= v if isinstance(v, dict) else {k: v}
    known = {f.name for f in fields(Settings)}
    out = replace(Settings(), **{k: _typed(k, v) for k, v in flat.items() if k in known})
    return replace(out, **{k: v for k, v in given.items() if v is not None})
