"""Sources (S*) and sinks (K*): table reads, fixture adapters and writers."""
