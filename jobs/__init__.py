"""Jobs that are run from the command line, each with a config file beside it."""
