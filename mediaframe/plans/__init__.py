"""Plans: settings, metadata policy, stage rules, codec slots."""
