"""A small corpus made from a seed, with labelled queries: something to try the
pipeline on, and to measure retrieval quality with. It is about an invented
harbour office, in seventeen files of which two are equal and one is a PDF."""

from __future__ import annotations

import json
import random
from pathlib import Path

SEED = 4711

#: path: title and paragraphs; {a} to {c} are numbers drawn from the seed.
NOTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "harbour.md": ("Port of Sandwick", ("The harbour office runs the port of Sandwick: berths, pilots, cranes and the ferry quay.", "Every ship that calls is a visit. A visit has a berth, a pilot and a bill.")),
    "rules/berths.md": ("Assigning a berth", ("A berth is assigned when the ship's draught is less than the depth at low water.", "To request a berth, the agent files form {a} two days before arrival. The duty officer confirms it by noon.", "A berth that stays empty for six hours falls to the next ship in line.")),
    "rules/pilots.md": ("Pilotage", ("Ships longer than eighty metres must take a pilot at the outer buoy.", "A pilot's licence is checked every spring by the examiner. A pilot without a licence may not board.", "The pilot boat leaves the inner pier {b} minutes before the meeting time.")),
    "rules/tides.md": ("Tide warnings", ("The gauge at the mole reports the water level every ten minutes.", "When the level rises above four metres, the siren sounds and subscribers get a message by radio.")),
    "tables/ship-fields.md": ("What is recorded of a ship", ("Name, flag, length, draught and tonnage are recorded of each ship. Names hold at most forty letters.", "Flags are two capital letters. The draught is measured in centimetres and never negative.")),
    "tables/visit-steps.md": ("Course of a visit", ("A visit is announced, confirmed, berthed, served and closed, in this order.", "When an announcement arrives, the clerk looks up the ship, then the berth plan, then writes the entry in the journal.", "A closed visit is billed within {c} days.")),
    "manuals/crane-start.md": ("Starting the crane", ("Check the wind: above fourteen knots the crane stays down.", "Switch on the main breaker, test the brake, then lift an empty hook.", "To shut the crane down, do the steps in reverse: lower the hook, lock the brake, open the breaker.")),
    "manuals/oil-spill.md": ("When oil is on the water", ("First close the sluice, then call the boom crew on channel nine.", "Lay the boom across the basin and photograph the sheen. The inspector takes a sample.", "Do not spray soap: it sinks the oil and harms the oyster beds.")),
    "manuals/archive.md": ("Keeping the journal safe", ("The journal is copied to the lighthouse each night and read back once a week.", "A copy older than a year goes to the county archive.")),
    "news/spring.md": ("News of the spring", ("The ferry quay was widened and has two ramps now.", "Agents can pay bills by bank transfer. The old stamp machine was removed.")),
    "news/autumn.md": ("News of the autumn", ("Repaired this autumn: the leaking fuel hose at pier three, the crane's limit switch and a wrong tide table.", "The radio mast got a new battery.")),
    "people/first-day.txt": ("Your first day", ("New clerks begin with the harbour overview, then walk the piers with the duty officer.", "Keys are handed out at the gatehouse. Ask for a life vest.")),
    "people/words.txt": ("Words of the trade", ("Draught: how deep a ship lies in the water. Lay day: a day on which loading is free of charge.", "Demurrage means the fee for keeping a ship beyond its lay days. Fender: a cushion between hull and quay.")),
    "links.md": ("Where to look", ("Berths, pilots and tides are under rules. Cranes and spills are under manuals.",)),
    "news/figures.txt": ("Figures", ("In the last month {a} ships called, {b} of them at night, and {c} bills were late.",)),
}
COPY = ("people/words-old.txt", "people/words.txt")
PDF_NAME, PDF_LINES = "plans/lighthouse.pdf", ("The lighthouse has a lamp of two kilowatts and a backup on batteries.", "Its beam is seen from nineteen miles.")

QUERIES: tuple[tuple[str, str], ...] = (
    ("How does an agent request a berth?", "rules/berths.md"),
    ("Who checks the licence of a pilot?", "rules/pilots.md"),
    ("What happens when the water level rises above four metres?", "rules/tides.md"),
    ("Which fields are recorded of a ship and how long may names be?", "tables/ship-fields.md"),
    ("What does the clerk do when an announcement arrives?", "tables/visit-steps.md"),
    ("In which order do I shut the crane down?", "manuals/crane-start.md"),
    ("What should I do first when oil is on the water?", "manuals/oil-spill.md"),
    ("How often is the journal copied to the lighthouse?", "manuals/archive.md"),
    ("What was widened in the spring?", "news/spring.md"),
    ("Which things were repaired this autumn?", "news/autumn.md"),
    ("What does the harbour office run?", "harbour.md"),
    ("What does demurrage mean?", "people/words-old.txt"),
    ("Where do new clerks begin?", "people/first-day.txt"),
    ("How far is the beam of the lighthouse seen?", PDF_NAME),
)


def pdf(lines: tuple[str, ...]) -> bytes:
    """A PDF with a page for each line."""
    kids = " ".join(f"{4 + 2 * k} 0 R" for k in range(len(lines)))
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(lines)} >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for k, line in enumerate(lines):
        shown = f"BT /F1 12 Tf 72 720 Td ({line}) Tj ET"
        objects += [f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * k} 0 R >>", f"<< /Length {len(shown)} >>\nstream\n{shown}\nendstream"]
    out, places = b"%PDF-1.4\n", []
    for k, body in enumerate(objects):
        places.append(len(out))
        out += f"{k + 1} 0 obj\n{body}\nendobj\n".encode()
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def write(root: str | Path, queries: str | Path | None = None, seed: int = SEED) -> dict[str, int]:
    """Writes the corpus under ``root``, and the labelled queries; the same
    bytes for the same seed. Files of other names are left alone."""
    r, base = random.Random(seed), Path(root)
    numbers = {k: r.randint(12, 95) for k in "abc"}
    texts = {path: f"# {title}\n\n" + "\n\n".join(p.format(**numbers) for p in parts) + "\n" for path, (title, parts) in NOTES.items()}
    texts[COPY[0]] = texts[COPY[1]]
    contents = {path: text.encode() for path, text in texts.items()} | {PDF_NAME: pdf(PDF_LINES)}
    for path, content in contents.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_bytes(content)
    if queries is not None:
        Path(queries).write_text(json.dumps({"queries": [{"query": q, "rel_doc": d} for q, d in QUERIES]}, indent=2) + "\n")
    return {"files": len(contents), "duplicates": 1, "pdf": 1, "queries": len(QUERIES)}
