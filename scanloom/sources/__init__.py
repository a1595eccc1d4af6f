"""Where files, history and container members come from, and where findings go."""
