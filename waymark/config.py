"""Limits and thresholds of site maps, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    pages_per_site: int = 50
    waves: int = 3
    sitemap_children: int = 5
    sitemap_candidates: int = 3
    robots_delay_ms: int = 10_000
    links_per_section: int = 25
    links_per_site: int = 150
    sections: int = 12
    optional_links: int = 25
    note_chars: int = 160
    least_note_chars: int = 15
    note_words: int = 12
    summary_chars: int = 200
    section_name_chars: int = 40
    chunk_links: int = 10
    skeleton_titles: int = 6
    body_chars: int = 2_000_000
    published_chars: int = 40
    check_hours: float = 6.0
    checks_per_run: int = 40
    regenerations_per_run: int = 2
    run_ms: int = 45_000
    regeneration_ms: int = 35_000
    pacer_ms: float = 150.0
    pacer_floor_ms: float = 100.0
    pacer_max_ms: float = 2_000.0


LIMITS = Limits()
