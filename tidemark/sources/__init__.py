"""Tables, generated data, log lines, file manifests and sinks."""
