"""Where an index lies, the ignore file, bindings of servers, and folders that clouds keep in step."""

from __future__ import annotations

import hashlib
import json
import os
import sys
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path, PurePath
from urllib.parse import urlparse

IGNORE = ".tesseraignore"
FOLDER = ".tessera"
STORE, HOME = "TESSERA_STORE", "TESSERA_HOME"

# What a new ignore file holds, by kind.
IGNORED = {
    "Vendored / third-party": "vendor/ third_party/ third-party/ external/", "Minified / generated code": "*.min.js *.min.css *.bundle.js *.chunk.js *.generated.*",
    "Build output": "dist/ build/ out/ target/ _build/", "Package managers": "node_modules/ bower_components/ jspm_packages/", "Language caches": "__pycache__/ *.pyc .tox/ .mypy_cache/ .pytest_cache/ .ruff_cache/ .eggs/",
    "IDE / editor": ".idea/ .vscode/ *.swp *.swo", "Version control": ".git/", "Virtual environments": "venv/ .venv/ env/ .env/", "Test snapshots": "__snapshots__/ *.snap", "Large data files": "*.csv *.json *.xml *.yaml *.yml *.lock",
}
# Names of folders, under a home, that clouds keep in step.
CLOUDS = {"iCloud Drive": ("Library/Mobile Documents/com~apple~CloudDocs", "iCloudDrive"), "Dropbox": ("Dropbox", "Library/CloudStorage/Dropbox*"), "Google Drive": ("Google Drive", "GoogleDrive", "Library/CloudStorage/GoogleDrive*"), "OneDrive": ("OneDrive", "OneDrive - *", "Library/CloudStorage/OneDrive*"), "Box": ("Box", "Box Sync", "Library/CloudStorage/Box*")}


def ignore_template() -> str:
    parts = [f"# {title}\n" + "\n".join(rules.split()) + "\n" for title, rules in IGNORED.items()]
    return f"# {IGNORE}: files and folders that are not indexed\n# Syntax: globs, folder/, /anchored, **, !negation\n\n" + "\n".join(parts)


def generate_ignore(root: str) -> tuple[bool, str]:
    """Writes the ignore file of a folder, unless there is one; whether it did, and where."""
    path = Path(root, IGNORE)
    if path.exists():
        return False, str(path)
    path.write_text(ignore_template())
    return True, str(path)


def read_ignore(root: str) -> list[str] | None:
    """The lines of a folder's ignore file; None if there is none."""
    path = Path(root, IGNORE)
    return path.read_text(encoding="utf-8").splitlines() if path.is_file() else None


def project_key(path: str) -> str:
    """The last name of a path, made safe for file names, and the first digits of the path's hash."""
    name = PurePath(path).name or "root"
    return "".join(c if c.isalnum() or c in "-_." else "_" for c in name) + "-" + hashlib.sha256(path.encode("utf-8", "surrogatepass")).hexdigest()[:8]


def data_home(env: Mapping[str, str] | None = None, platform: str = sys.platform) -> Path:
    """Where data of a user lies: as the environment says, else as is usual on the platform."""
    env = os.environ if env is None else env
    if env.get(HOME):
        return Path(env[HOME])
    if env.get("XDG_DATA_HOME"):
        return Path(env["XDG_DATA_HOME"], "tessera")
    home = Path(env.get("HOME") or Path.home())
    if platform == "win32":
        return Path(env.get("LOCALAPPDATA") or home / "AppData/Local", "tessera")
    return home / ("Library/Application Support/tessera" if platform == "darwin" else ".local/share/tessera")


def store_path(root: str, env: Mapping[str, str] | None = None) -> str:
    """Where the index of a folder (or of a file's folder) lies; a setting names it outright, on any store."""
    if not root or not str(root).strip():
        raise ValueError("no folder given")
    env = os.environ if env is None else env
    if env.get(STORE):
        return env[STORE].rstrip("/") + "/" + project_key(root)
    base = Path(root).resolve()
    return str(data_home(env) / "projects" / project_key(str(base.parent if base.is_file() else base)))


def table_path(root: str, table: str, env: Mapping[str, str] | None = None) -> str:
    return f"{store_path(root, env)}/{table}"


def migrate(root: str, new: str) -> bool:
    """Moves an index that lies in its own folder, from before, to its new place, if nothing is there; whether it did."""
    old = Path(root, FOLDER)
    if not old.is_dir() or Path(new).exists():
        return False
    Path(new).parent.mkdir(parents=True, exist_ok=True)
    old.rename(new)
    return True


def own_file(path: str) -> bool:
    """Whether a path is the engine's own, which is never watched."""
    return FOLDER in PurePath(path).parts or PurePath(path).name.startswith("._tessera")


def within(path: str, root: str) -> bool:
    """Whether a path lies in a folder, links followed."""
    inner, outer = Path(path).resolve(), Path(root).resolve()
    return inner == outer or outer in inner.parents


def workspace(env: Mapping[str, str] | None = None, cwd: str | None = None) -> str | None:
    """The folder to begin with: of the environment, of the mount, of the shell, the present one; none that is as shallow
    as a home's parent."""
    env = os.environ if env is None else env
    for path in (env.get("TESSERA_WORKSPACE"), "/workspace", env.get("PWD"), cwd or os.getcwd()):
        if path and os.path.isdir(path) and (path == "/workspace" or len(PurePath(path).parts) >= 3):
            return path
    return None


# ---- files that are written


def write_file(path: str, text: str, shown: str = "") -> str:
    """Writes a source file; what is said of it."""
    new = not os.path.exists(path)
    try:
        Path(path).write_text(text, encoding="utf-8")
    except OSError as e:
        return f"Failed to write {shown or path}: {e}"
    lines = text.count("\n") + (1 if text and not text.endswith("\n") else 0)
    return f"{'Created' if new else 'Wrote'} {shown or path} ({lines} lines)"


# ---- clouds


def cloud_folders(home: str | None = None) -> dict[str, list[Path]]:
    """Folders under a home that a cloud keeps in step, by cloud."""
    base = Path(home or Path.home())
    found = {name: [p for g in globs for p in sorted(base.glob(g)) if p.is_dir()] for name, globs in CLOUDS.items()}
    return {name: own for name, own in found.items() if own}


def cloud_synced(path: str, home: str | None = None) -> tuple[bool, str | None]:
    """Whether a path lies in such a folder, and whose."""
    for name, folders in cloud_folders(home).items():
        if any(within(path, str(f)) for f in folders):
            return True, name
    return False, None


# ---- bindings of language servers


def words(command: Sequence[str] | str | None) -> list[str]:
    return command.split() if isinstance(command, str) else [str(x) for x in command or []]


def load_bindings(path: str) -> dict[str, list[str]]:
    """Commands by language; of a file that is missing or damaged none."""
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    found = data.get("servers", data) if isinstance(data, dict) else {}
    return {str(k): own for k, v in found.items() if isinstance(v, (str, list)) and (own := words(v))}


def save_bindings(bindings: Mapping[str, Sequence[str] | str], path: str) -> str:
    own = {k: words(v) for k, v in sorted(bindings.items()) if words(v)}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    part = Path(path).with_name(Path(path).name + ".part")
    part.write_text(json.dumps({"servers": own}, indent=2) + "\n", encoding="utf-8")
    part.replace(path)
    return path


def bind(language: str, command: Sequence[str] | str, path: str) -> list[str]:
    if not words(command):
        raise ValueError("no command given")
    save_bindings(load_bindings(path) | {language: words(command)}, path)
    return words(command)


def unbind(language: str, path: str) -> bool:
    """Whether there was a binding."""
    own = load_bindings(path)
    if language not in own:
        return False
    del own[language]
    save_bindings(own, path)
    return True


def server_command(language: str, default: Sequence[str], path: str, variable: str, env: Mapping[str, str] | None = None) -> tuple[list[str], str]:
    """A language's command, and where it comes from: its binding, the environment, or the default."""
    if own := load_bindings(path).get(language):
        return own, "binding"
    if own := words((os.environ if env is None else env).get(variable)):
        return own, "env"
    return list(default), "default"


def endpoint(command: Sequence[str] | str | None) -> dict | None:
    """Where to attach, of a command that is one address: tcp://host:port or unix:///path; else None."""
    own = words(command)
    if len(own) != 1:
        return None
    at = urlparse(own[0])
    try:
        if at.scheme == "tcp" and at.hostname and at.port:
            return {"transport": "tcp", "host": at.hostname, "port": at.port}
    except ValueError:
        return None
    return {"transport": "unix", "path": at.path} if at.scheme == "unix" and at.path else None


def candidates(*lists: Iterable[tuple[str, Sequence[str] | str | None]]) -> list[tuple[str, list[str]]]:
    """(source, command) of all lists, in order; each different command once."""
    out: dict[tuple, str] = {}
    for source, command in (x for own in lists for x in own):
        if key := tuple(words(command)):
            out.setdefault(key, source)
    return [(source, list(key)) for key, source in out.items()]
