"""Where rows come from: tables, exchange messages."""
