"""Text forms of results, for collected top-k rows."""

from __future__ import annotations

from xml.sax.saxutils import escape

SECTIONS = ("general_knowledge", "project_memories", "other_projects")


def attribute(value: object) -> str:
    return str(value).replace('"', "&quot;")


def preview(text: str | None, limit: int) -> str:
    flat = " ".join((text or "").split())
    return flat[:limit] + "…" if len(flat) > limit else flat


def results(rows: list[dict], limit: int = 160) -> str:
    """Sections of results, each record one element with its id, score and project."""
    out = []
    for name in SECTIONS:
        own = [r for r in rows if r["section"] == name]
        if own:
            lines = [f'  <memory id="{attribute(r["id"][:8])}" score="{r["score"]:.4f}" quality="{attribute(r.get("quality", ""))}">{escape(preview(r.get("content"), limit))}</memory>' for r in own]
            out.append("\n".join([f"<{name}>", *lines, f"</{name}>"]))
    return "\n".join(out) or "<no_results/>"


def tag_cloud(tags: list[str]) -> str:
    first: dict[str, str] = {}
    for t in tags:
        first.setdefault(t.lower(), t)
    return f"<tags>{', '.join(first[k] for k in sorted(first))}</tags>" if first else ""


def hints(n_other_projects: int, n_global: int) -> list[str]:
    out = []
    if n_other_projects:
        out.append(f"{n_other_projects} of these results come from other projects.")
    if n_global:
        out.append(f"{n_global} of these results are general knowledge.")
    return out
