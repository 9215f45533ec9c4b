"""Plans that join operators: retrieve, fuse and evaluate."""
