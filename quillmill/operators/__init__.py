"""DataFrame-to-DataFrame operators: conversations, cleaning, dedup, scoring, reports."""
