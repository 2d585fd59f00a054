"""gaugeworks.sources"""
