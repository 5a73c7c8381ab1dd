"""Configuration (S12, K9, F6): a small YAML file, found by name, with overrides compiled at once."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from quarrylens.operators.overrides import compiled

#: Names tried in this order.
NAMES = ("quarrylens.yaml", "quarrylens.yml", "config.yaml")


@dataclass(frozen=True)
class Config:
    path: str = "."
    extensions: tuple[str, ...] = ("php",)
    ignore: tuple[str, ...] = ()
    rules: tuple[str, ...] = ()
    analysis_level: int | None = None
    overrides: dict[str, list[str]] = field(default_factory=dict)


def _scalar(s: str):
    s = s.strip()
    if s[:1] in "'\"" and s[-1:] == s[:1] and len(s) > 1:
        return s[1:-1].replace("''", "'") if s[0] == "'" else re.sub(r"\\(.)", r"\1", s[1:-1])
    s = re.sub(r"\s#.*$", "", s).strip()
    if s in ("", "~", "null"):
        return None
    if s.startswith("[") and s.endswith("]"):
        return [_scalar(x) for x in s[1:-1].split(",") if x.strip()]
    return int(s) if re.fullmatch(r"-?\d+", s) else s


def read_yaml(text: str) -> dict:
    """Mappings of scalars, lists and one further level, as configuration files have them."""
    out: dict = {}
    key = inner = None
    for raw in text.split("\n"):
        line = raw.rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        body = line.lstrip(" ")
        indent = len(line) - len(body)
        if body.startswith("- "):
            target = out[key] if inner is None else out[key][inner]
            if target is None or isinstance(target, dict) and not target:
                target = []
                if inner is None:
                    out[key] = target
                else:
                    out[key][inner] = target
            target.append(_scalar(body[2:]))
            continue
        m = re.match(r"(\"[^\"]*\"|'[^']*'|[^:]+):(?:\s+(.*))?$", body)
        if not m:
            raise ValueError(f"not a setting: {raw!r}")
        name, value = _scalar(m[1]), _scalar(m[2]) if m[2] else None
        if indent == 0:
            key, inner = name, None
            out[key] = value
        else:
            if not isinstance(out[key], dict):
                out[key] = {}
            inner = name
            out[key][inner] = value
    return out


def load(path: str | Path) -> Config:
    d = read_yaml(Path(path).read_text())
    listed = lambda k: tuple(d.get(k) or ()) if isinstance(d.get(k), list) or d.get(k) is None else (d[k],)
    overrides = {k: v if isinstance(v, list) else [v] for k, v in (d.get("overrides") or {}).items() if v is not None}
    compiled(overrides)  # a bad expression is an error here, not in a task
    return Config(d.get("path") or ".", listed("extensions") or ("php",), listed("ignore"), listed("rules"), d.get("analysis_level"), overrides)


def discover(folder: str | Path) -> Path | None:
    """First existing file of NAMES; directories of that name are passed over."""
    return next((p for p in (Path(folder) / n for n in NAMES) if p.is_file()), None)


def dump(c: Config) -> str:
    """K9: the effective configuration; override codes in order."""
    quote = lambda s: '"' + str(s).replace("\\", "\\\\").replace('"', '\\"') + '"'
    out = [f"path: {quote(c.path)}"]
    for name in ("extensions", "ignore", "rules"):
        values = getattr(c, name)
        out += [f"{name}:" + ("" if values else " []"), *(f"  - {quote(v)}" for v in values)]
    out.append(f"analysis_level: {'null' if c.analysis_level is None else c.analysis_level}")
    if c.overrides:
        out.append("overrides:")
        for code in sorted(c.overrides):
            out += [f"  {quote(code)}:", *(f"    - {quote(p)}" for p in c.overrides[code])]
    return "\n".join(out) + "\n"
