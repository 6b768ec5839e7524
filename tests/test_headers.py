"""Header rows of all files of a folder."""

from tidewright.functions import headers as H
from tidewright.sources.headers import header_rows

NAMES = {n.lower() for k, v in H.STANDARD.items() for n in [k, *v]}


def expected(lines):
    """Scores as told in words."""
    best = None
    for i, line in enumerate(lines[:5]):
        cells = [c.strip().lower() for c in line.split(",") if c.strip()]
        score = known = 0
        if len(cells) >= 5:
            known = int(sum(1 if c in NAMES else 0.5 if any(n in c for n in NAMES) else 0 for c in cells))
            above = sum(any(w.lower() in c for w in H.ABOVE_HEADERS) for c in cells)
            score = max(0.0, min(1.0, known / len(cells) - 0.5 * above / len(cells) - 0.05 * i))
        if best is None or score > best[1]:
            best = (i, score, known)
    return best


def test_files(spark, tmp_path):
    files = {
        "plain.csv": ["Customer#,Company,Street,City,State,Zip", "1,A,2 Oak,Troy,OH,45373"],
        "report.csv": ["Export Report,Date: today,,,", "", "Cust#,Company Name,Address1,Town,ST,Zip Code,Phone", "1,A,x,y,z,w,v"],
        "unknown.csv": ["a,b,c,d,e,f", "1,2,3,4,5,6"],
        "few.csv": ["Company,City", "x,y"],
        "late.csv": ["x,x,x,x,x"] * 5 + ["Customer#,Company,Street,City,State"],
        "partly.csv": ["my city,the company of all,q,r,s,t", "1,2,3,4,5,6"],
        "above.csv": ["Data source,Company,City,State,Zip,Phone"],
    }
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    (tmp_path / "empty.csv").write_text("")
    got = {r["file"].rsplit("/", 1)[-1]: r for r in header_rows(spark, str(tmp_path)).collect()}
    assert set(got) == set(files)
    for name, lines in files.items():
        row, score, known = expected([x for x in lines])
        assert (got[name]["row"], round(got[name]["score"], 9), got[name]["known"]) == (row, round(score, 9), known), name
        assert got[name]["header"] == (lines[row].split(",") if lines[row] else [""])
        assert got[name]["skip"] == (row > 0 and score >= 0.7)
    assert got["report.csv"]["row"] == 2 and got["report.csv"]["skip"]
