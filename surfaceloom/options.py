"""Options of a deduplication; they are settled when the plan is built, so each combination is a plan of its own."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SurfaceOptions:
    #: Fold ids: numbers anywhere, UUIDs, long hexadecimals, and stems with an id.
    fold_ids: bool = False
    #: Keep what the garbage gate drops; no static-file rule, no junk tokens, no folding of bare or covered records.
    keep_invalid: bool = False
    #: Keep stylesheets, images, fonts and media.
    keep_assets: bool = False
    #: Tell paths apart by case.
    case_sensitive: bool = False
    #: Comparisons of key sets for each record, at most; 0: all of them, below 0: none.
    merge_cap: int = 0
    #: Tell records apart by the whole query.
    whole_query: bool = False
    #: No templates for path segments.
    raw_segments: bool = False
    #: Keep percent-code remnants in front of hosts.
    raw_hosts: bool = False
    #: Put out the line as it was read.
    raw_output: bool = False

    @property
    def merging(self) -> bool:
        return not self.whole_query and not self.keep_invalid
