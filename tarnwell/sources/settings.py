"""Settings and small records kept as files beside the engine: read and written by the driver only."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path


@dataclass
class Server:
    host: str = ""
    scan_roots: list[str] = field(default_factory=list)
    label: str | None = None
    enabled: bool = True


@dataclass
class Settings:
    """Every field has a default, so a file may give any part."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    deleted_keep_days: int = 30
    full_sync: str = "03:00"
    embedding_model: str = "hash"
    plugin_dir: str = "plugins"
    threads: int | None = None
    servers: dict[str, Server] = field(default_factory=dict)

    def enabled_servers(self) -> list[tuple[str, Server]]:
        """Enabled servers by name; with none configured, the include list is one server named local."""
        if not self.servers and self.include:
            return [("local", Server(scan_roots=list(self.include), label="local"))]
        return sorted((n, s) for n, s in self.servers.items() if s.enabled)

    def sync_time(self) -> tuple[int, int]:
        """Hour and minute of the daily sync; 3 and 0 for what cannot be read."""
        hour, _, minute = self.full_sync.partition(":")
        return int(hour) if hour.isdigit() else 3, int(minute) if minute.isdigit() else 0


#: Place of each field in the file: (table, key).
PLACES = {
    "include": ("scan", "include"),
    "exclude": ("scan", "exclude"),
    "deleted_keep_days": ("retention", "deleted_keep_days"),
    "full_sync": ("schedule", "full_sync"),
    "embedding_model": ("embedding", "model"),
    "plugin_dir": ("plugins", "dir"),
}


def load(path: str) -> Settings:
    """Settings of a TOML file; a missing file is written with the defaults. A single ``scan_root`` of a server counts as its roots."""
    file = Path(path)
    if not file.exists():
        save(Settings(), path)
    raw = tomllib.loads(file.read_text())
    found = {f: raw[t][k] for f, (t, k) in PLACES.items() if k in raw.get(t, {})}
    servers = {}
    for name, s in raw.get("servers", {}).items():
        roots = s.get("scan_roots") or ([s["scan_root"]] if "scan_root" in s else [])
        servers[name] = Server(s.get("host", ""), roots, s.get("label"), s.get("enabled", True))
    return Settings(**found, threads=raw.get("threads"), servers=servers)


def _table(name: str, values: dict) -> list[str]:
    # JSON's strings, numbers, booleans and lists are TOML too.
    return [f"[{name}]", *(f"{k} = {json.dumps(v, ensure_ascii=False)}" for k, v in values.items() if v is not None), ""]


def save(settings: Settings, path: str) -> None:
    lines = [f"threads = {settings.threads}", ""] if settings.threads is not None else []
    tables: dict[str, dict] = {}
    for f, (t, k) in PLACES.items():
        tables.setdefault(t, {})[k] = getattr(settings, f)
    for name, values in tables.items():
        lines += _table(name, values)
    for name, server in settings.servers.items():
        lines += _table(f"servers.{json.dumps(name)}", asdict(server))
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join(lines))


def load_records(path: str, default: list | dict) -> list | dict:
    """Pending items or corrections; an absent file is the default."""
    return json.loads(Path(path).read_text()) if Path(path).exists() else default


def save_records(records: list | dict, path: str) -> None:
    Path(path).write_text(json.dumps(records, indent=2, ensure_ascii=False))


def correct(path: str, pattern: str, threshold: int = 3) -> dict:
    """Count a corrected pattern; the history and the threshold are kept."""
    known = load_records(path, {"threshold": threshold, "patterns": []})
    mine = next((p for p in known["patterns"] if p["pattern"] == pattern), None)
    if mine is None:
        known["patterns"].append(mine := {"pattern": pattern, "count": 0})
    mine["count"] += 1
    save_records(known, path)
    return known
