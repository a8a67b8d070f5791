import random

from sequential_model import score
from test_merge import T0, compare, make_posting

from hirelake.operators import merge


def repeating(n):
    """Postings whose identifiers, addresses and texts recur with other periods, one source with a third of all."""
    rng, rows = random.Random(1), []
    for i in range(n):
        r = make_posting(rng, i)
        skills = (["python", "sql", "aws"], ["react"], ["sql", "excel"], ["python", "git", "sql", "go"], ["excel"], [])[i % 6]
        url = f"https://x.example/{i % 3}/{i % 16}"
        r.update(
            source="remoteok" if i % 3 == 0 else "lever" if i % 5 < 3 else "fuzu", source_job_id=f"J{i % 8}", title=f"Role {i if i % 7 > 2 else i % 7}",
            company="Unknown company" if i % 11 == 0 else f"Co {i % 37}", job_type=("contract", "unknown")[i % 5 == 4], skills=skills, tags=skills,
            job_url=url, apply_url=url, canonical_url=url, location_city=("Nairobi", None)[i % 2], location_country=None, location=("Berlin", "Kenya")[i % 6 > 3],
            experience_level=("senior", "unknown")[i % 6 == 5], source_website=("", "a.example")[i % 8 > 0], description=f"text {i}",
            salary_text="1 - 2" if i % 4 == 0 else None, salary_min=None, salary_max=None, description_sections=[], posted_at=T0, scraped_at=T0,
            discovered_at=T0)
        r["aggregated_sources"] = [r["source"]]
        r["quality_score"] = score(r)
        rows.append(r)
    return rows


def test_a_chain_of_moves_does_not_cost_a_round_per_link(spark, monkeypatch):
    rounds, moved = [], merge._moved
    monkeypatch.setattr(merge, "_moved", lambda rows: rounds.append(1) or moved(rows))
    compare(spark, [], repeating(480))
    assert len(rounds) <= 10
