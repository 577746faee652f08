"""Workspaces: documents with their sources, rules and edits, shared views, and the tables that result from them."""

from __future__ import annotations

import copy
import json
import re
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..sources.text import LARGEST
from .edits import Overlay
from .joins import View, run_view
from .query import Rules, focus_columns, process, with_result_index
from .table import Table

# The version of saved workspaces, kinds of files, bounds of what is taken in.
VERSION = 20
WORKSPACE_KINDS = ("ota-workspace", "table-tool-tabs")
CONFIG_KIND, VIEW_KIND = "table-tool-config", "join-view"
DEPTH, KEYS, ITEMS, DOCUMENTS, VIEWS, TITLE, CACHED = 12, 2000, 10000, 100, 500, 40, 8
UNSAFE = ("__proto__", "prototype", "constructor")
PAGE_SIZES = (50, 100, 250, 500)
PREFERENCES = {"theme": "light", "copyFormat": "default", "copyWithHeaders": True, "spreadsheetSafe": True, "persistRaw": True}


def default_ui() -> dict:
    return {"displayTables": None, "enabledViews": None, "rules": {}, "columnFilters": {}, "globalFilter": "", "enableHighlight": True, "onlyHighlighted": False, "pageSize": 100, "cellEdits": {}, "importFormat": "auto", "importHeaderMode": "auto", "exportOnlyChecked": False, "exportCols": "all"}


def is_safe(value, depth: int = 0) -> bool:
    """Whether a decoded JSON value is neither too deep nor too wide, and has no key that means something to a browser."""
    if depth > DEPTH:
        return False
    if isinstance(value, list):
        return len(value) <= ITEMS and all(is_safe(v, depth + 1) for v in value)
    if isinstance(value, dict):
        return len(value) <= KEYS and not any(k in UNSAFE for k in value) and all(is_safe(v, depth + 1) for v in value.values())
    return value is None or isinstance(value, str | int | float | bool)


def migrated(payload: dict) -> dict:
    """A saved workspace in today's version. Version 0 may lack its lists; the other steps change the number alone."""
    version = payload.get("schemaVersion")
    version = version if isinstance(version, int) and not isinstance(version, bool) else 0
    if version > VERSION:
        raise ValueError("the workspace comes from a newer version")
    if version < 0:
        raise ValueError(f"no way from version {version}")
    out = {**payload, "schemaVersion": VERSION}
    if version == 0:
        out |= {k: payload[k] if isinstance(payload.get(k), list) else [] for k in ("docs", "globalViews")}
    return out


def clean_title(title: str) -> str:
    return re.sub(r"\s+", " ", title or "").strip()


@dataclass
class Document:
    id: str
    title: str
    raw: str = ""
    ui: dict = field(default_factory=default_ui)
    source_revision: int = 0
    parsed: dict | None = None

    def __post_init__(self):
        self.ui = {**default_ui(), **self.ui}
        if self.ui["pageSize"] not in PAGE_SIZES:
            self.ui["pageSize"] = 100

    def overlay(self) -> Overlay:
        """The document's edits: ui.cellEdits maps a table's name to {"row:column": value}."""
        over = Overlay()
        for name, cells in self.ui["cellEdits"].items():
            over.cells[name] = {tuple(map(int, place.split(":"))): value for place, value in cells.items() if re.fullmatch(r"\d+:\d+", place)}
        return over

    def keep_edits(self, over: Overlay) -> None:
        self.ui["cellEdits"] = {name: {f"{r}:{c}": v for (r, c), v in cells.items()} for name, cells in over.cells.items()}

    def rules(self, name: str) -> Rules:
        own = self.ui["rules"].get(name) or {}
        return Rules(own.get("filter") or "", own.get("highlight") or "", own.get("focus") or [], dict(self.ui["columnFilters"].get(name) or {}))

    def active_filters(self) -> list[tuple[str, str, str]]:
        """(level, where, text) of every filter that is set: global, table, highlight, column."""
        found = [("global", "", self.ui["globalFilter"])]
        for name, own in self.ui["rules"].items():
            found += [("table", name, own.get("filter") or ""), ("highlight", name, own.get("highlight") or "")]
        for name, columns in self.ui["columnFilters"].items():
            found += [("column", f"{name}.{c}", text) for c, text in columns.items()]
        return [f for f in found if str(f[2] or "").strip()]


class Workspace:
    """At least one document, one of them active; views are shared. on_event gets the name of every change."""

    def __init__(self, on_event: Callable[[str, dict], None] | None = None):
        self.docs: list[Document] = []
        self.views: dict[str, View] = {}
        self.preferences = dict(PREFERENCES)
        self.revision = self.view_revision = self.query_revision = 0
        self.load_failed = False
        self._on_event, self._cache = on_event, OrderedDict()
        self.active_id = ""
        self.add()

    def _changed(self, event: str, **about) -> None:
        self.revision += 1
        if self._on_event:
            self._on_event(event, about)

    # Documents.
    @property
    def active(self) -> Document:
        return self.document(self.active_id)

    def document(self, doc_id: str) -> Document | None:
        return next((d for d in self.docs if d.id == doc_id), None)

    def _title(self, title: str, own: str = "") -> str:
        """At most 40 characters, unlike all others: a number in brackets takes the end."""
        used, clean = {d.title for d in self.docs if d.id != own}, clean_title(title) or "Analysis"
        out, n = clean[:TITLE], 2
        while out in used:
            end = f" ({n})"
            out, n = clean[: max(1, TITLE - len(end))] + end, n + 1
        return out

    def add(self, title: str | None = None, raw: str = "", ui: dict | None = None) -> Document:
        numbers = [int(m[1]) for d in self.docs if (m := re.fullmatch(r"Analysis\s+(\d+)", d.title, re.I))]
        doc = Document(uuid.uuid4().hex, self._title(title or f"Analysis {max(numbers, default=0) + 1}"), raw, ui or {})
        self.docs.append(doc)
        self.activate(doc.id)
        return doc

    def activate(self, doc_id: str) -> bool:
        if self.document(doc_id) is None:
            return False
        self.active_id = doc_id
        self._changed("document:active", doc_id=doc_id)
        return True

    def remove(self, doc_id: str) -> bool:
        """False for the last document or an unknown one. Beside the active one the document before it becomes active."""
        at = next((i for i, d in enumerate(self.docs) if d.id == doc_id), -1)
        if at < 0 or len(self.docs) == 1:
            return False
        self.docs.pop(at)
        if self.active_id == doc_id:
            self.active_id = self.docs[max(0, at - 1)].id
        self._changed("document:removed", doc_id=doc_id)
        return True

    def duplicate(self, doc_id: str) -> Document | None:
        """A copy without edits, as they name rows of the other."""
        source = self.document(doc_id)
        if source is None:
            return None
        ui = {**copy.deepcopy(source.ui), "cellEdits": {}}
        return self.add(f"{source.title} (copy)", source.raw, ui)

    def rename(self, doc_id: str, title: str) -> bool:
        doc = self.document(doc_id)
        if doc is None or not clean_title(title):
            return False
        doc.title = self._title(title, doc_id)
        self._changed("document:renamed", doc_id=doc_id)
        return True

    def move(self, doc_id: str, beside: str, after: bool = False) -> bool:
        doc, target = self.document(doc_id), self.document(beside)
        if doc is None or target is None or doc is target:
            return False
        self.docs.remove(doc)
        self.docs.insert(self.docs.index(target) + after, doc)
        self._changed("document:moved", doc_id=doc_id)
        return True

    def set_ui(self, doc_id: str | None = None, **values) -> None:
        """Filters, focus, shown tables, enabled views and other settings of a document."""
        (self.document(doc_id) if doc_id else self.active).ui.update(values)
        self.query_revision += 1
        self._changed("query:changed", keys=sorted(values))

    def replace_source(self, raw: str, doc_id: str | None = None, fmt: str | None = None, header_mode: str | None = None) -> int:
        """The document's revision. A new text, format or header mode drops its edits and makes running parses stale."""
        doc = self.document(doc_id) if doc_id else self.active
        new = {"importFormat": fmt or doc.ui["importFormat"], "importHeaderMode": header_mode or doc.ui["importHeaderMode"]}
        if doc.raw != raw or any(doc.ui[k] != v for k, v in new.items()):
            doc.raw, doc.parsed = raw, None
            doc.ui.update(new, cellEdits={})
            doc.source_revision += 1
            self._changed("source:changed", doc_id=doc.id)
        return doc.source_revision

    def parse_completed(self, doc_id: str, source_revision: int, **result) -> bool:
        """False, and nothing kept, if the source has changed since the parse began."""
        doc = self.document(doc_id)
        if doc is None or source_revision != doc.source_revision:
            if self._on_event:
                self._on_event("parse:stale", {"doc_id": doc_id, "source_revision": source_revision})
            return False
        doc.parsed = {"source_revision": source_revision, **result}
        self._changed("parse:completed", doc_id=doc_id)
        return True

    # Views.
    def _views_changed(self) -> None:
        self.view_revision += 1
        self._changed("views:changed")

    def put_view(self, view: View, old_name: str | None = None) -> None:
        """Adds a view or takes the place of the one of its (or its old) name."""
        kept = [(n, v) for n, v in self.views.items() if n != view.view or n == (old_name or n)]
        at = old_name or view.view
        self.views = {(view.view if n == at else n): (view if n == at else v) for n, v in kept} | {view.view: view}
        self._views_changed()

    def remove_views(self, names: list[str]) -> int:
        gone = [n for n in names if self.views.pop(n, None)]
        if gone:
            self._views_changed()
        return len(gone)

    def replace_views(self, views: list[View]) -> None:
        self.views = {v.view: v for v in views[:VIEWS]}
        self._views_changed()

    def import_views(self, text: str, overwrite: bool = True) -> int:
        """Views from JSON: a list, {kind: join-view, view}, {globalViews}, {views} or one view. A name that is taken is
        overwritten, or else the new view gets a number."""
        data = json.loads(text)
        if not is_safe(data):
            raise ValueError("unsafe or too deep")
        if isinstance(data, dict):
            single = data.get("kind") == VIEW_KIND and isinstance(data.get("view"), dict)
            data = [data["view"]] if single else data.get("globalViews") or data.get("views") or ([data] if data.get("left") else [])
        found = [v for v in map(view_of, data) if v]
        for v in found:
            name, n = v.view, 2
            while not overwrite and v.view in self.views:
                v.view, n = f"{name}_{n}", n + 1
            self.put_view(v)
        return len(found)

    def export_views(self, names: list[str] | None = None) -> str:
        return json.dumps({"globalViews": [view_json(v) for n, v in self.views.items() if names is None or n in names]})

    def find_views(self, text: str = "") -> list[View]:
        """Views with text, whatever its case, in name, sources or condition; by name."""
        has = lambda v: any(text.lower() in part.lower() for part in (v.view, v.left, v.right, v.on))
        return sorted(filter(has, self.views.values()), key=lambda v: v.view)

    # Files.
    def payload(self) -> dict:
        docs = [{"id": d.id, "title": d.title, "raw": d.raw if self.preferences["persistRaw"] else "", "sourceRevision": d.source_revision, "ui": d.ui} for d in self.docs]
        return {"kind": WORKSPACE_KINDS[0], "schemaVersion": VERSION, "docs": docs, "activeId": self.active_id, "globalViews": [view_json(v) for v in self.views.values()], "preferences": self.preferences}

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON line on any file system that Spark writes. After a failed load nothing is overwritten."""
        if self.load_failed:
            raise RuntimeError("the saved workspace could not be read; it is not overwritten")
        spark.createDataFrame([(json.dumps(self.payload(), ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def load(self, spark: SparkSession, path: str) -> int:
        try:
            return self.import_workspace(json.loads(spark.read.text(path).first()[0]))
        except Exception:
            self.load_failed = True
            raise

    def import_workspace(self, payload: dict, merge: bool = False) -> int:
        """Takes the documents of a saved workspace, instead of or beside those here. Nothing changes if it is refused."""
        if not isinstance(payload, dict) or not is_safe(payload):
            raise ValueError("unsafe or too deep")
        if payload.get("kind") not in WORKSPACE_KINDS:
            raise ValueError("not a workspace")
        payload = migrated(payload)
        given = payload.get("docs")
        if not isinstance(given, list) or not 0 < len(given) <= DOCUMENTS or not all(isinstance(d, dict) for d in given):
            raise ValueError(f"1 to {DOCUMENTS} documents are taken")
        text = lambda d, k: d[k] if isinstance(d.get(k), str) else ""
        if any(len(text(d, "raw")) * 2 > LARGEST for d in given):
            raise ValueError("a source is too large")
        views = [v for v in map(view_of, payload.get("globalViews") or []) if v][:VIEWS]
        self.docs = self.docs if merge else []
        used, first = {d.id for d in self.docs}, len(self.docs)
        for i, d in enumerate(given):
            doc_id = text(d, "id")
            doc_id = uuid.uuid4().hex if not doc_id or doc_id in used else doc_id
            used.add(doc_id)
            revision = d.get("sourceRevision")
            title = self._title(text(d, "title") or f"Analysis {first + i + 1}")
            self.docs.append(Document(doc_id, title, text(d, "raw"), d["ui"] if isinstance(d.get("ui"), dict) else {}, revision if isinstance(revision, int) and revision >= 0 else 0))
        if isinstance(payload.get("globalViews"), list):
            self.replace_views(views)
        self.preferences |= {k: v for k, v in (payload.get("preferences") or {}).items() if k in PREFERENCES}
        self.load_failed = False
        self.activate(self.docs[first].id)
        return len(given)

    def export_config(self) -> dict:
        """Rules and views, without sources."""
        return {"kind": CONFIG_KIND, "globalViews": [view_json(v) for v in self.views.values()], "docs": [{"id": d.id, "title": d.title, "ui": d.ui} for d in self.docs]}

    def import_config(self, payload: dict, create: bool = False) -> tuple[int, list[str]]:
        """(documents that took settings, titles without a document). Titles count before ids; create adds the others."""
        if not isinstance(payload, dict) or payload.get("kind") != CONFIG_KIND or not is_safe(payload):
            raise ValueError("not a configuration")
        if isinstance(payload.get("globalViews"), list):
            self.replace_views([v for v in map(view_of, payload["globalViews"]) if v])
        given = payload.get("docs") if isinstance(payload.get("docs"), list) else []
        applied, missing = 0, []
        for d in [d for d in given if isinstance(d, dict)] if len(given) <= DOCUMENTS else []:
            ui = d["ui"] if isinstance(d.get("ui"), dict) else {}
            doc = next((x for x in self.docs if x.title == d.get("title")), None) or self.document(d.get("id"))
            if doc:
                doc.ui = {**default_ui(), **ui}
                applied += 1
            else:
                missing.append(d.get("title") or d.get("id"))
                if create:
                    self.add(d.get("title"), ui=ui)
        self.query_revision += 1
        self._changed("config:imported")
        return applied, missing

    # Results.
    def columns_of(self, name: str, tables: list[Table]) -> list[str]:
        """Headers of a table or a view; a table hides a view of its name."""
        by_name = {t.name: t for t in tables}
        found = by_name.get(name) or (run_view(self.views[name], by_name, self.views) if name in self.views else None)
        return list(found.headers) if found else []

    def _edited(self, doc: Document, tables: list[Table]) -> list[Table]:
        over = doc.overlay()
        return [over.apply(t) for t in tables]

    def _joined(self, doc: Document, tables: list[Table]) -> list[Table]:
        by_name = {t.name: t for t in tables}
        made = (run_view(self.views[n], by_name, self.views) for n in doc.ui["enabledViews"] or [] if n in self.views)
        return [t for t in made if t is not None]

    def _shown(self, doc: Document, tables: list[Table]) -> list[Table]:
        chosen = doc.ui["displayTables"]
        return tables if chosen is None else [t for t in tables if t.name in set(chosen)]

    def results(self, tables: list[Table], doc_id: str | None = None) -> list[Table]:
        """The shown tables and enabled views after edits, filters, marks and focus, with _result_index.

        Views join all tables, shown or not. The last eight results are kept, oldest out first; a result holds
        until its source, the views or the settings change.
        """
        doc = self.document(doc_id) if doc_id else self.active
        key = (doc.id, doc.source_revision, self.view_revision, self.query_revision, tuple(id(t) for t in tables), json.dumps(doc.ui, sort_keys=True))
        if key not in self._cache:
            edited = self._edited(doc, tables)
            every = self._shown(doc, edited) + self._joined(doc, edited)
            ui = doc.ui
            done = [with_result_index(process(t, doc.rules(t.name), ui["globalFilter"], ui["enableHighlight"], ui["onlyHighlighted"])) for t in every]
            self._cache[key] = tables, done  # the tables are held, so that no other gets their identity
            while len(self._cache) > CACHED:
                self._cache.popitem(last=False)
        return self._cache[key][1]

    def exported(self, tables: list[Table], variant: str = "preview", doc_id: str | None = None) -> list[Table]:
        """raw: the tables, edits put in. full: with the enabled views, unfiltered; if so set, the shown tables and focused
        columns alone. preview: the results, all pages."""
        doc = self.document(doc_id) if doc_id else self.active
        if variant == "preview":
            return self.results(tables, doc.id)
        edited = self._edited(doc, tables)
        if variant == "raw":
            return edited
        every = (self._shown(doc, edited) if doc.ui["exportOnlyChecked"] else edited) + self._joined(doc, edited)
        return [_focused(t, doc.rules(t.name).focus) for t in every] if doc.ui["exportCols"] == "shown" else every


def _focused(table: Table, focus: list[str]) -> Table:
    places = focus_columns(list(table.headers), focus)
    df = table.df.select(*table.order, *[table.cells[p].alias(f"c{i}") for i, p in enumerate(places)])
    return table.with_df(df, headers=tuple(table.headers[p] for p in places), sources=tuple(places))


def view_of(data) -> View | None:
    """A view from JSON; None without name or sources."""
    if not isinstance(data, dict) or not all(isinstance(data.get(k), str) and data[k] for k in ("view", "left", "right")):
        return None
    return View(data["view"], data["left"], data["right"], data.get("on") or "", data.get("type") or "inner", data.get("select") or "")


def view_json(view: View) -> dict:
    return {"view": view.view, "left": view.left, "right": view.right, "type": view.type, "on": view.on, "select": view.select}
