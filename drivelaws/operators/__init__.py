"""DataFrame operators: samples, class fits, estimates, rankings, merges, reshapes, studies."""
