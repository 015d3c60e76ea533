"""Options of an extraction, from Python, a TOML file or a command line."""

from __future__ import annotations

import argparse
import json
import tomllib
from dataclasses import dataclass, fields

@dataclass(frozen=True)
class Config:
    """Timeouts are in seconds. sweep: exact looks for expired flows on the clock of the packets as one table of flows
    would, every expiration_check_interval; none expires flows on their next packet only, and needs no ordered pass."""

    features: str = "basic"
    active_timeout: int = 3600
    idle_timeout: int = 120
    early_export: int | None = None
    expiration_check_interval: int = 60
    sweep: str = "exact"
    output: str = "print"
    export_path: str | None = None
    header: bool = False
    drop_contaminant_features: bool = False
    packet_graph: bool = False

    def __post_init__(self) -> None:
        if self.output not in ("print", "csv") or (self.output == "csv" and not self.export_path):
            raise ValueError("output is print, or csv with an export_path")
        if self.sweep not in ("exact", "none"):
            raise ValueError("sweep is exact or none")


def from_toml(path: str) -> Config:
    """Options in any table of the file."""
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    flat = {k: v for part in [raw, *(v for v in raw.values() if isinstance(v, dict))] for k, v in part.items() if not isinstance(v, dict)}
    known = {f.name for f in fields(Config)}
    return Config(**{k.replace("-", "_"): v for k, v in flat.items() if k.replace("-", "_") in known})


def to_toml(config: Config, path: str) -> None:
    """The options as a TOML file that from_toml() reads."""
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else json.dumps(v, ensure_ascii=False)
    with open(path, "w", encoding="utf-8") as f:
        f.write("[config]\n" + "".join(f"{x.name} = {text(v)}\n" for x in fields(config) if (v := getattr(config, x.name)) is not None))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="netloom", description="Flow features from packets")
    p.add_argument("--config-file")
    p.add_argument("-f", "--features", help="basic, cic, cidds, nfstream, wide, custom or a registered set")
    p.add_argument("--active-timeout", type=int)
    p.add_argument("--idle-timeout", type=int)
    p.add_argument("--early-export", type=int)
    p.add_argument("--expiration-check-interval", type=int)
    p.add_argument("--sweep", choices=("exact", "none"))
    p.add_argument("-o", "--output", choices=("print", "csv"))
    p.add_argument("--export-path")
    p.add_argument("--header", action="store_true", default=None)
    p.add_argument("--drop-contaminant-features", action="store_true", default=None)
    p.add_argument("--save-config", help="writes the options to a TOML file")
    p.add_argument("--packet-graph", action="store_true", default=None)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("pcap").add_argument("path")
    live = sub.add_parser("events")
    live.add_argument("path")
    live.add_argument("--ingress-only", action="store_true")
    return p


def from_args(args: argparse.Namespace) -> Config:
    base = from_toml(args.config_file) if args.config_file else Config()
    given = {f.name: v for f in fields(Config) if (v := getattr(args, f.name, None)) is not None}
    return Config(**{**{f.name: getattr(base, f.name) for f in fields(Config)}, **given})
