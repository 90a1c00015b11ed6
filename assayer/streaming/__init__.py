"""Row rules on streams: the quarantine, and counts of broken rules in time windows."""
