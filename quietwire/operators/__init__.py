"""DataFrame operators: profiles, similarity, safety, scoring, decisions, evaluation, checks."""
