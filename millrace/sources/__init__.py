"""Where rows come from: topics, captured changes, routes, and the benchmark tables."""
