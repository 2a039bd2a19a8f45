"""Semantic queries over labelled data cubes, planned for and run by Spark."""
