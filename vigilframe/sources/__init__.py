"""Sources and sinks: line archives, feeds, landed service replies, snapshots."""
