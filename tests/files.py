"""Small release files for tests: three releases of one made-up collection."""

from __future__ import annotations

from pathlib import Path

from snapweave.sources.layouts import LAYOUTS


def write_release(path: Path, layout: str, rows: list[dict], variant: str | None = None, width: int | None = None, ending: str = "\n", tail: str = "", headers: dict[int, str] | None = None) -> str:
    """A file in a layout: cells by field name, other cells empty; ``tail`` is put behind every line."""
    x = LAYOUTS[layout]
    width = width or x.widths[0]
    head = [f"_unused_{k}" for k in range(1, width + 1)]
    head[0], head[1] = x.signature[0].replace("_", " ").title(), x.signature[1].replace("_", " ").title()
    for k, text in (headers or {}).items():
        head[k - 1] = text
    lines = ["\t".join(head)]
    for row in rows:
        cells = [""] * width
        for name, value in row.items():
            cells[x.column(name, variant) - 1] = str(value)
        lines.append("\t".join(cells))
    path.write_bytes(("".join(line + tail + ending for line in lines)).encode())
    return str(path)


def sample(gid: str, iid: str, group: str = "Group_One", **more) -> dict:
    return {"genetic_id": gid, "individual_id": iid, "group_id": group, "snps_hit_1240k": 1000, **more}


OLD = [
    sample("K7", "K7", "Coast_Hunter"),
    sample("Hunter.DG", "K7", "Coast_Hunter.DG", snps_hit_1240k=2000),
    sample("Hunter_b.DG", "K7", "Coast_Hunter.DG", snps_hit_1240k=3000),
    sample("P4.DG", "P4", "Other_Pop"),
    sample("P5.SG", "P5", "Test_Pop"),
]
MID = [
    sample("K7.AG", "Hunter", "Coast_Late.AG"),
    sample("Hunter.DG", "Hunter", "Coast_Late.DG", snps_hit_1240k=2500),
    sample("Hunter_b.DG", "Hunter", "Coast_Late.DG"),
    sample("P4.DG", "P4", "Test_Pop"),
    sample("P5.DG", "P5", "Test_Pop"),
]
NEW = [
    sample("Hunter.AG", "Hunter", "Coast_Hunter_Late", persistent_genetic_id=33),
    sample("Hunter.DG", "Hunter", "Coast_Hunter_Late", persistent_genetic_id=39136),
    sample("P3.SG", "P3", "Test_Pop", persistent_genetic_id=3),
    sample("P4.DG", "P4", "Test_Pop", persistent_genetic_id=4),
    sample("P5.AG", "P5", "Test_Pop", persistent_genetic_id=5),
]


def three_releases(folder: Path) -> list[str]:
    return [
        write_release(folder / "a_v54.1_1240K_public.anno", "C", OLD),
        write_release(folder / "v62.0_1240k_public.anno", "D", MID),
        write_release(folder / "v66.p1.data.PUB.anno", "E", NEW),
    ]
