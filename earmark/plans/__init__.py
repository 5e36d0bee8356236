"""Plans: operators combined into the queries users run, each next to equivalent SQL where SQL can say it."""
